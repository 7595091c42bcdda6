"""Token ids of documents as binary files with Elias-Fano encoded boundaries, a Spark data source of its own.

A file holds one concatenated array of ids, two or four bytes each, and in its footer the places where documents
end and the documents' ids, both rising sequences in Elias-Fano code: the low bits of each number side by side, the
high bits as a bit vector in which the i-th one stands at (number >> low bits) + i. A directory of one 32-bit count
for each 512 bits finds the i-th one, so a document's place costs about two bits and the low bits instead of 64.

Files follow each other in ascending order of documents. Tasks write files under names of their own and report
them; the driver numbers the files of the tasks that succeeded and publishes them in ``manifest.json``, one line
of a few numbers a file. A task that runs again leaves files that no manifest names.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from skysift.llm.common import Recent, in_batches
from skysift.session import shared_dir

MAGIC = b"SKYIDS01"
#: Ids and documents of a file, and ids of a reading task, beyond which the next one begins.
FILE_IDS, FILE_DOCS, SPLIT_IDS = 1 << 28, 1 << 19, 1 << 24
#: Documents and bytes of ids handed over at once by a reader.
BATCH_DOCS, BATCH_BYTES = 2048, 4 * 2**20
BLOCK = 512
FOOTER = struct.Struct("<QQQQBQ8s")
#: Words, and parts of words, held in a Python worker's memory; no bounds on input.
REMEMBERED, PARTS = 50_000, 200_000
#: Texts of spaces, letters and signs that are the same in every version of Unicode of the last decades: Latin, Cyrillic, Kana, Han.
SETTLED = re.compile("[\\t-\\r -~\u00a1-\u024f\u0400-\u0482\u048a-\u04ff\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]*")


class EliasFano:
    """A rising sequence of whole numbers from 0 on, in little more than the space it must have."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values`` (unsigned 64-bit, rising) in code; at most 2^32 - 1 of them."""
        n = len(values)
        if n >= 1 << 32:
            raise ValueError("too many numbers for a directory of 32 bits")
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        places, packed = np.arange(low_bits, dtype=np.uint64), [np.empty(0, np.uint8)]
        for begin in range(0, n, 1 << 13):
            bits = (values[begin : begin + (1 << 13), None] >> places) & np.uint64(1)
            packed.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        high = np.zeros(-(-(n + (last >> low_bits) + 1) // BLOCK) * BLOCK, np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        ones = np.concatenate([[0], np.cumsum(high.reshape(-1, BLOCK).sum(axis=1))[:-1]]).astype(np.uint32)
        return cls(n, low_bits, np.concatenate(packed), np.packbits(high, bitorder="little"), ones)

    def _select(self, i: int) -> int:
        """The place of the i-th one (from 0) among the high bits."""
        block = int(np.searchsorted(self.ones, i, "right")) - 1
        part = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part)[i - int(self.ones[block])])

    def get(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        begin = i * self.low_bits
        part = int.from_bytes(self.low[begin // 8 : (begin + self.low_bits + 7) // 8].tobytes(), "little")
        low = (part >> (begin % 8)) & ((1 << self.low_bits) - 1)
        return ((self._select(i) - i) << self.low_bits) | low

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The numbers from the ``start``-th to before the ``stop``-th."""
        if stop <= start:
            return np.empty(0, np.uint64)
        first, last = self._select(start), self._select(stop - 1)
        part = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")
        at = np.flatnonzero(part) + first // 8 * 8
        at = at[(at >= first) & (at <= last)] - np.arange(start, stop)
        begin, end = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        bits = bits[: end - begin].reshape(stop - start, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (at.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def dump(self) -> bytes:
        sizes = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return sizes + self.low.tobytes() + self.high.tobytes() + self.ones.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts at a place of ``data``, and the place after it."""
        n, low_bits, lows, highs = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        ones = np.frombuffer(data, "<u4", highs * 8 // BLOCK, at + lows + highs)
        return cls(n, low_bits, low, high, ones), at + lows + highs + 4 * len(ones)


@dataclass(frozen=True)
class Footer:
    """What stands behind the ids of a file."""

    n_ids: int
    width: int
    nulls: int
    least: int
    ends: EliasFano
    names: EliasFano

    def dump(self) -> bytes:
        body = self.ends.dump() + self.names.dump()
        return body + FOOTER.pack(len(body), self.n_ids, self.nulls, self.least + 2**63, self.width, 0, MAGIC)

    @classmethod
    def read(cls, file) -> Footer:
        size = file.size()
        file.seek(size - FOOTER.size)
        length, n_ids, nulls, least, width, _, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        file.seek(size - FOOTER.size - length)
        body = file.read(length)
        ends, at = EliasFano.load(body)
        return cls(n_ids, width, nulls, least - 2**63, ends, EliasFano.load(body, at)[0])

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        """Ids of documents; those without one come first."""
        known = self.names.slice(max(0, start - self.nulls), max(0, stop - self.nulls)).tolist()
        return [None] * max(0, min(stop, self.nulls) - start) + [self.least + v for v in known]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder by its scheme; without one, the machines' shared local paths."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Part:
    """A file that a task wrote."""

    name: str
    docs: int
    ids: int


@dataclass
class Written(WriterCommitMessage):
    task: int
    parts: list[Part]


class _File:
    """One file in the making: ids go out as they come, boundaries and document ids wait for the footer."""

    def __init__(self, system: fs.FileSystem, folder: str, width: int):
        self.name = f"ids-{uuid.uuid4().hex}.bin"
        self.out, self.width = system.open_output_stream(f"{folder}/{self.name}"), width
        self.sizes: list[np.ndarray] = []
        self.names: list[int | None] = []
        self.ids = 0

    def add(self, names: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= 1 << (8 * self.width)):
            raise ValueError(f"an id does not fit into {self.width} bytes")
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.names += names
        self.sizes.append(sizes)
        self.ids += len(ids)

    def close(self) -> Part:
        known = [v for v in self.names if v is not None]
        least, nulls = (known[0] if known else 0), len(self.names) - len(known)
        if any(v is not None for v in self.names[:nulls]) or any(a > b for a, b in zip(known, known[1:])):
            raise ValueError("documents are not in ascending order of their ids")
        ends = np.cumsum(np.concatenate(self.sizes) if self.sizes else np.empty(0, np.int64)).astype(np.uint64)
        names = np.fromiter((v - least for v in known), np.uint64, len(known))
        self.out.write(Footer(self.ids, self.width, nulls, least, EliasFano.of(ends), EliasFano.of(names)).dump())
        self.out.close()
        return Part(self.name, len(self.names), self.ids)


class IdWriter(DataSourceArrowWriter):
    """Writes rows (doc_id long, ids array<int>), in the order of the tasks and of the rows within each."""

    def __init__(self, options: dict[str, str]):
        self.path, self.width = options["path"], int(options.get("width", 4))
        self.file_ids = int(options.get("file_ids", FILE_IDS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        (system, folder), parts, file = _opened(self.path), [], None
        system.create_dir(folder)
        for batch in iterator:
            names, lists = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            begin = 0
            while begin < len(names):
                file = file or _File(system, folder, self.width)
                # As many rows as the file takes, one at least.
                room = self.file_ids - file.ids
                stop = min(max(begin + 1, int(np.searchsorted(at, at[begin] + room, "right")) - 1), begin + FILE_DOCS - len(file.names), len(names))
                file.add(names[begin:stop], sizes[begin:stop], flat[at[begin] : at[stop]])
                begin = stop
                if file.ids >= self.file_ids or len(file.names) >= FILE_DOCS or begin < len(names):
                    parts.append(file.close())
                    file = None
        if file:
            parts.append(file.close())
        return Written(TaskContext.get().partitionId(), parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder)
        parts, docs, ids = [], 0, 0
        for part in chain.from_iterable(m.parts for m in sorted((m for m in messages if m), key=lambda m: m.task)):
            parts.append({"name": part.name, "docs": part.docs, "ids": part.ids, "first_doc": docs, "first_id": ids})
            docs, ids = docs + part.docs, ids + part.ids
        with system.open_output_stream(f"{folder}/manifest.tmp") as out:
            out.write(json.dumps({"docs": docs, "ids": ids, "files": parts}).encode())
        system.move(f"{folder}/manifest.tmp", f"{folder}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for part in chain.from_iterable(m.parts for m in messages if m):
            system.delete_file(f"{folder}/{part.name}")


@dataclass
class Span(InputPartition):
    """Some documents of a file, and the number of ids in the files before it."""

    name: str
    start: int
    stop: int
    before: int


class IdReader(DataSourceReader):
    """Reads the files that a manifest names: a task takes some documents of one file."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split_ids = options["path"], int(options.get("split_ids", SPLIT_IDS))

    def partitions(self) -> list[Span]:
        system, folder = _opened(self.path)
        with system.open_input_stream(f"{folder}/manifest.json") as file:
            files = json.loads(file.read())["files"]
        spans = []
        for f in files:
            pieces = max(1, min(f["docs"], -(-f["ids"] // self.split_ids)))
            cuts = [f["docs"] * k // pieces for k in range(pieces + 1)]
            spans += [Span(f["name"], a, b, f["first_id"]) for a, b in zip(cuts, cuts[1:])]
        return spans or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        system, folder = _opened(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as file:
            footer = Footer.read(file)
            at = partition.start
            while at < partition.stop:
                yield_to, batch = self._batch(file, footer, at, partition.stop, partition.before)
                yield batch
                at = yield_to

    def _batch(self, file, footer: Footer, start: int, stop: int, before: int) -> tuple[int, pa.RecordBatch]:
        stop = min(stop, start + BATCH_DOCS)
        begin = footer.ends.get(start - 1) if start else 0
        ends = footer.ends.slice(start, stop).astype(np.int64)
        rows = max(1, int(np.searchsorted(ends, begin + BATCH_BYTES // 4, "right")))
        ends = ends[:rows]
        file.seek(begin * footer.width)
        ids = np.frombuffer(file.read((int(ends[-1]) - begin) * footer.width), f"<u{footer.width}")
        starts = np.concatenate([[begin], ends[:-1]])
        offsets = pa.array(np.concatenate([starts, ends[-1:]]) - begin, pa.int32())
        columns = [
            pa.array(footer.doc_ids(start, start + rows), pa.int64()), pa.array(starts + before), pa.array(ends - starts),
            pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
            pa.array([ids[a - begin : b - begin].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ]
        return start + rows, pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids", "ids_le"])


class TokenIds(DataSource):
    """Format ``token_ids``. Options: path; width (bytes of an id, 2 or 4), file_ids (ids of a file); split_ids (ids of a reading task)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>, ids_le binary"

    def reader(self, schema) -> IdReader:
        return IdReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> IdWriter:
        return IdWriter(dict(self.options))


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """The content of a tokenizer's JSON file. A vocabulary is small by nature."""
    local = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(local).select("content").first()[0]).decode()


@lru_cache(maxsize=1)
def _settled_ranges() -> dict[str, str]:
    """The letters and the numbers among composed and lowered ``SETTLED`` characters, as ranges for a set of ``re``."""
    settled = [c for c in map(chr, range(0x10000)) if SETTLED.fullmatch(c)]
    some = sorted({c for s in settled for c in unicodedata.normalize("NFC", s).lower()})
    ranges = {}
    for kind in (r"\p{L}", r"\p{N}"):
        runs: list[list[int]] = []
        for at in (ord(c) for c in some if regex.fullmatch(kind, c)):
            if runs and at == runs[-1][1] + 1:
                runs[-1][1] = at
            else:
                runs.append([at, at])
        ranges[kind] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
    return ranges


def _finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern in composed and lowered ``SETTLED`` texts, by ``re``, which takes half the time, if it can say it."""
    plain = pattern
    for kind, ranges in _settled_ranges().items():
        plain = plain.replace(kind, ranges)
    in_sets = r"\p" not in regex.sub(r"\[[^\]]*\]", "", pattern)
    return (re.compile(plain) if in_sets and r"\p" not in plain else regex.compile(pattern)).findall


def _splitter(content: str) -> Callable[[str], list[str]] | None:
    """The pattern by which a tokenizer parts words after composing and lowering them; None if it has other steps."""
    form = json.loads(content)
    normal = form.get("normalizer") or {}
    steps, split = normal.get("normalizers", [normal]), (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, spaces, {"type": "Lowercase"}] or [s["type"] for s in split] != ["Split", "ByteLevel"]:
        return None
    words, level = split
    if (words["behavior"], words["invert"], level["add_prefix_space"], level["use_regex"]) != ("Removed", True, False, False):
        return None
    return _finder(words["pattern"]["Regex"])


#: The characters by which the byte level of a tokenizer stands for bytes: themselves if visible, others from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


def _byte_level(part: str) -> str:
    """A part of a word as its UTF-8 bytes, a character each, in the tokenizer's alphabet."""
    return part.encode().decode("latin-1").translate(_LEVEL)


class Words:
    """Encodes words by a tokenizer of the library and remembers them, as 32-bit numbers.

    The library's model encodes what its splitter makes of a word; these parts are remembered too, as the same ones
    occur in many words. Texts of ``SETTLED`` characters are composed, lowered and split here by the tokenizer's
    pattern, others word by word by the library's steps, which take ten times as long.
    """

    def __init__(self, content: str):
        self.tokenizer, self.split = Tokenizer.from_str(content), _splitter(content)
        # Taken once: each look at the attribute makes a new object.
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: Recent[str, bytes] = Recent(self._part, PARTS)
        self.known: Recent[bytes, bytes] = Recent(self._word, REMEMBERED)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenize(part if part.isascii() else _byte_level(part))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.split and SETTLED.fullmatch(text):
            return self._settled(text)
        normal = self.tokenizer.normalizer.normalize_str(text)
        ids = [t.id for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for t in self.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _settled(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(unicodedata.normalize("NFC", text).lower())))

    def text_ids(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian 32-bit numbers."""
        if self.split and SETTLED.fullmatch(text or ""):
            return self._settled(text or "")
        return b"".join(map(self.known.__getitem__, (text or "").encode().split()))


@lru_cache(maxsize=2)
def _words(content: str) -> Words:
    return Words(content)


def encode(docs: DataFrame, content: str, end: int | None = None) -> DataFrame:
    """doc_id and ids of the whole text of each row in the order of the rows, with the id ``end`` behind them if given.

    ``content`` is the JSON of a tokenizer that drops white space and never joins what it stands between, so texts are
    split at ASCII white space and each distinct word is encoded once by the tokenizers library. Strings of special
    tokens are ordinary text. A null or empty text has no ids but the end.
    """
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(content)
        for batch in batches:
            rows = [words.text_ids(t) + tail for t in batch.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, run, "doc_id long, ids array<int>")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending order of ids over all tasks: null first, rows of one id by a hash, then by their texts.

    Rows are dealt by ranges of id and hash, so rows that share an id may go to several tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.withColumn("dealt", F.xxhash64("text"))
    return keyed.repartitionByRange("doc_id", "dealt").sortWithinPartitions("doc_id", "dealt", "text").select("doc_id", "text")


def write(tokens: DataFrame, path: str, width: int, **options: int) -> None:
    """Write rows (doc_id, ids) that are in order; ``width`` bytes hold an id. Further options as in ``TokenIds``."""
    tokens.sparkSession.dataSource.register(TokenIds)
    tokens.write.format("token_ids").options(width=width, **options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids, and ``ids_le``: the ids as little-endian 32-bit numbers."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").options(**options).load(path)


def through_files(docs: DataFrame, content: str, end: int, **options: int) -> DataFrame:
    """Encode all documents, write them in ascending order of their ids, and read the files back.

    Equal rows are written each for itself. Columns but doc_id and text are not looked at. The files stay in the
    shared folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/llm/token-ids-{uuid.uuid4().hex}"
    size = max(Tokenizer.from_str(content).get_vocab_size(), end + 1)
    write(encode(in_order(docs), content, end), folder, 2 if size <= 1 << 16 else 4, **options)
    return read(spark, folder)
