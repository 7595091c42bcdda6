"""Byte-level BPE encoding and decoding with a given rank file.

Bytes stand as the Latin-1 characters of an Aho-Corasick automaton over all tokens. A piece of text is
encoded from left to right with the longest token that starts at each place; a token that cannot follow the
one before it is given up for the next shorter one, and where none is left the search steps back. Whether
two tokens may stand side by side depends on the two alone and is remembered. The result equals that of
merging by rank, in time that grows with the length of the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import Recent, in_batches, picked, with_fields

#: Pieces, and pairs of tokens, held in a Python worker's memory; no bounds on input.
REMEMBERED, PAIRS = 200_000, 200_000


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The content of a rank file (one base64 token and its rank a line). A vocabulary is small by nature."""
    local = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(local).select("content").first()[0])


@lru_cache(maxsize=2)
def tokens_of(content: bytes) -> dict[int, bytes]:
    """The bytes of each rank of a rank file."""
    lines = (line.split() for line in content.splitlines() if line.strip())
    return {int(rank): base64.b64decode(token) for token, rank in lines}


class Encoder:
    """Encodes pieces of bytes by the ranks of a vocabulary."""

    def __init__(self, content: bytes):
        self.token = tokens_of(content)
        self.rank = {token: rank for rank, token in self.token.items()}
        # How each token is made by merging its own bytes: its last two parts, or itself for a byte.
        self.parts: dict[int, tuple[int, int]] = {}
        self.plain = False
        for token, rank in self.rank.items():
            steps = self._merge(token)
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
            elif steps is not None:
                self.parts[rank] = steps
        self.plain = not self._ordered()
        self.automaton = ahocorasick.Automaton()
        self.named = {self.token[rank].decode("latin-1"): rank for rank in self.parts}
        for name, rank in self.named.items():
            self.automaton.add_word(name, rank)
        self.automaton.make_automaton()
        self.reach = max(map(len, self.named), default=1)
        self.shorter = {rank: self._longest_within(self.token[rank][:-1]) for rank in self.parts}
        self.fits: Recent[tuple[int, int], bool] = Recent(self._may_follow, PAIRS)
        self.known: Recent[str, bytes] = Recent(self._ids, REMEMBERED)

    def _ordered(self) -> bool:
        """Whether all bytes are tokens and every token outranks its parts; else pieces are merged step by step."""
        return all(bytes([b]) in self.rank for b in range(256)) and all(
            max(pair) < rank for rank, pair in self.parts.items() if len(self.token[rank]) > 1
        )

    def _longest_within(self, token: bytes) -> int | None:
        """The longest token of the automaton that ``token`` starts with."""
        for end in range(len(token), 0, -1):
            rank = self.rank.get(token[:end])
            if rank in self.parts:
                return rank
        return None

    def _merges(self, piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The parts left after merging by rank, lowest rank first and leftmost of equals, and the last merge."""
        parts, last = [piece[i : i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            able = [(r, i) for i, r in enumerate(ranks) if r is not None]
            if not able:
                break
            i = min(able)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _merge(self, token: bytes) -> tuple[int, int] | None:
        """The two parts last merged into ``token``; None if merging its bytes does not give it."""
        parts, last = self._merges(token)
        if len(parts) != 1 or last is None or last[0] not in self.rank or last[1] not in self.rank:
            return None
        return self.rank[last[0]], self.rank[last[1]]

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of two tokens side by side ends with these two.

        Undoes the merges of both in falling order of rank; they stand if no merge across the border was
        to come before the one undone last.
        """
        (left, right), before = pair, 1 << 62
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < before:
                return False
            if left > right and self.parts[left][0] != left:
                before, left = left, self.parts[left][1]
            elif self.parts[right][0] != right:
                # Equal ranks merge from the left, so a border merge of the same rank would have come first.
                before, right = right + 1, self.parts[right][0]
            elif self.parts[left][0] != left:
                before, left = left, self.parts[left][1]
            else:
                return True

    def _piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        if self.plain:
            return tuple(self.rank[p] for p in self._merges(piece)[0])
        n, name = len(piece), piece.decode("latin-1")
        dead = bytearray(n + 1)
        path: list[int] = []
        at, token, fits = 0, self._longest_at(name, 0), self.fits
        while at < n:
            while token is not None:
                end = at + len(self.token[token])
                if not dead[end] and (not path or fits[path[-1], token]):
                    break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = path.pop()
                at -= len(self.token[token])
                token = self.shorter[token]
            else:
                path.append(token)
                at = end
                token = self._longest_at(name, at) if at < n else None
        return tuple(path)

    def _longest_at(self, name: str, at: int) -> int:
        """The longest token that starts at a place: the automaton's longest path, back to where a token ends."""
        part = name[at : at + self.reach]
        size = self.automaton.longest_prefix(part)
        while (rank := self.named.get(part[:size])) is None:
            size -= 1
        return rank

    def encode(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece of text."""
        return self._piece(piece.encode("utf-8"))

    def _ids(self, piece: str) -> bytes:
        return np.array(self.encode(piece), np.int32).tobytes()

    def text_ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of a text's pieces."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32)


@lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    """The encoder of a vocabulary, made once in a Python worker."""
    return Encoder(content)


def encode(docs: DataFrame, content: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without its text and with the token ids of it; ``content`` is that of a rank file.

    Each match of ``pattern`` is encoded by itself; text outside of matches does not count, special tokens are
    ordinary text. A null or empty text has no ids. Whole texts are encoded, whatever their length; rows
    do not depend on each other, so repeated rows and null ids pass through.
    """
    rest = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, model = regex.compile(pattern).findall, encoder(content)
        for batch in batches:
            parts = [model.text_ids(find(value or "")) for value in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], _lists(parts)], [*rest, ids])

    added = T.StructField(ids, T.ArrayType(T.IntegerType()))
    return in_batches(picked(docs, [*rest, text]), run, with_fields(picked(docs, rest), added))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int32)])))


def round_trip(docs: DataFrame, content: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without its text, with its token ids and the bytes that these decode to; both as in ``encode`` and ``decode``.

    One pass: the ids need not leave the Python worker to be decoded.
    """
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, model = regex.compile(pattern).findall, encoder(content)
        token = model.token.__getitem__
        for batch in batches:
            parts = [model.text_ids(find(value or "")) for value in batch.column(len(rest)).to_pylist()]
            back = pa.array([b"".join(map(token, part.tolist())) for part in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], _lists(parts), back], [*rest, ids, decoded])

    kept = picked(docs, rest)
    fields = T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())
    return in_batches(picked(docs, [*rest, text]), run, with_fields(kept, *fields))


def decode(tokens: DataFrame, content: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of its ids; a null list gives null, an id outside the vocabulary an error."""
    names = [c for c in tokens.columns if c != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens_of(content).__getitem__
        at = names.index(ids)
        for batch in batches:
            column = batch.column(at)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(
                [0, *(n or 0 for n in column.value_lengths().to_pylist())]
            )
            back = [
                b"".join(map(token, flat[s:e].tolist())) if known else None
                for s, e, known in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*names, decoded])

    given = picked(tokens, names)
    return in_batches(given, run, with_fields(given, T.StructField(decoded, T.BinaryType())))


def digests(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids (decimals joined by commas) and of the decoded bytes."""
    rows = docs.select("doc_id", "text")
    back = round_trip(rows, content, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
