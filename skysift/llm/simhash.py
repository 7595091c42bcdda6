"""Near copies by SimHash: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most ``max_bits`` bits agree in at least ``8 - max_bits`` of their
eight bytes. The index posts every fingerprint under each set of that many positional bytes, so two
fingerprints that reach the guaranteed minimum meet under at least one set. Where they meet, the shared
positional bytes are tallied from the differing bits; a pair counts only under its first shared set, and
stays if the bit distance confirms it. Postings of one byte would grow with the square of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import free_name, in_batches, keep, picked, row_key, same, text_rows
from skysift.llm.components import components

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, shingle: int) -> int:
    """Fingerprint of one text as an unsigned number; zero without words."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    joined, sizes = memoryview(b" ".join(words)), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row, fp) per document: its id, the key of its row, and its fingerprint as a signed long.

    Letters A-Z are lowered; words are runs without white space of ASCII; a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t, shingle) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"]
            )

    rows = text_rows(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    return in_batches(rows, run, "doc_id long, row string, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _postings(fps: DataFrame, matches: int) -> DataFrame:
    """Every fingerprint under each set of ``matches`` positional bytes.

    A posting's name holds the set (as a bit mask), the mask of all positions up to its last, and the bytes.
    """
    names = []
    for chosen in combinations(range(8), matches):
        mask, upto = sum(1 << p for p in chosen), (2 << chosen[-1]) - 1
        bytes_ = [F.shiftleft(_byte(F.col("fp"), p), 8 * i) for i, p in enumerate(chosen)]
        value = bytes_[0]
        for b in bytes_[1:]:
            value = value.bitwiseOR(b)
        names.append(F.struct(F.lit(upto * 256 + mask).alias("set"), value.alias("value")))
    return fps.select("fp", F.explode(F.array(*names)).alias("p")).select("fp", "p.set", "p.value")


def linked(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in the column ``fp`` that differ in at most ``max_bits`` bits.

    ``max_bits`` is below 8: beyond, no positional byte is guaranteed to be shared.
    """
    if not 0 <= max_bits < 8:
        raise ValueError("max_bits must be between 0 and 7")
    matches = 8 - max_bits
    postings = _postings(fps.select("fp"), matches)
    one, two = postings.alias("one"), postings.alias("two")
    differ = F.col("one.fp").bitwiseXOR(F.col("two.fp"))
    shared = F.lit(0)
    for p in range(8):
        shared = shared + F.when(_byte(differ, p) == 0, F.lit(1 << p)).otherwise(F.lit(0))
    here, upto = F.col("one.set").bitwiseAND(255), F.shiftright(F.col("one.set"), 8)
    meet = (
        (F.col("one.set") == F.col("two.set"))
        & (F.col("one.value") == F.col("two.value"))
        & (F.col("one.fp") < F.col("two.fp"))
        & (F.bit_count(differ) <= max_bits)
        & (F.bit_count(shared) >= matches)
        & (shared.bitwiseAND(upto) == here)
    )
    # The size of the postings is guessed from the table that they come from, so they must not be sent to every task.
    return one.join(two.hint("merge"), meet).select(F.col("one.fp").alias("a"), F.col("two.fp").alias("b"))


def grouped(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, row, fp, root, component_id) per document.

    component_id is the smallest id of the documents reachable through links, null if none of them has an id;
    root is the smallest fingerprint of the component. Copies of a fingerprint are reduced to one before the
    search; links are only sought between different fingerprints. Repeated rows share one key and one result;
    an empty table gives no rows.
    """
    marked = keep(fingerprints(docs, shingle), "fingerprints").df
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes").df
    least = components(linked(classes, max_bits))
    member = classes.join(least, classes["fp"] == least["node"], "left").select(
        "fp", F.coalesce("least", "fp").alias("root"), "first_id"
    )
    ids = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = member.join(ids, "root").select(F.col("fp").alias("fp_"), "root", "component_id")
    return marked.join(placed, F.col("fp") == F.col("fp_")).select("doc_id", "row", "fp", "root", "component_id")


def near_copies(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, row, fp, component_id, head) per document, as in ``grouped``.

    head is the row key of the one document that stands for the component: the least row key among the rows
    of its smallest id.
    """
    found = grouped(docs, shingle, max_bits)
    heads = (
        found.where(same(F.col("doc_id"), F.col("component_id")))
        .groupBy(F.col("root").alias("root_"))
        .agg(F.min("row").alias("head"))
    )
    return found.join(heads, F.col("root") == F.col("root_")).select("doc_id", "row", "fp", "component_id", "head")


def component_rows(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id per document."""
    return grouped(docs, shingle, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents with one of each group of near copies: all columns, rows of the groups' heads.

    Of rows that repeat a head's id and text, one stays.
    """
    heads = keep(near_copies(docs, shingle, max_bits).where("row = head").select("row"), "heads").df
    key = free_name(docs, "row_key")
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, row_key(id_, text))
    kept = keyed.join(heads.distinct().withColumnRenamed("row", key), key, "left_semi")
    if heads.count() > heads.distinct().count():
        kept = kept.dropDuplicates([key])
    return picked(kept, docs.columns)
