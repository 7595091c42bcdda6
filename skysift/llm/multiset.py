"""Document fingerprints by a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (a line) is hashed to a wide vector: SHA-512 in sixteen lanes of 32 bits, and a sparse part of
64 lanes of 16 bits in which every piece of the paragraph (a sentence, cut after 80 characters) adds 1 or
takes 1 away in one lane. A document's fingerprint is the sum of the vectors of its paragraphs, lane by lane
modulo 2^32 and 2^16. So equal multisets of paragraphs have equal fingerprints in any order, and inserting
or deleting a paragraph is an addition or subtraction. The sparse part keeps inner products: the cosine of
two of them estimates what share of their pieces two documents have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import keep, text_rows

WIDE, WIDE_BITS = 16, 32
SPARSE, SPARSE_BITS = 64, 16
PIECE = r"[^.!?\n]{1,80}"


def with_lanes(df: DataFrame, text: str, wide: str, sparse: str) -> DataFrame:
    """``df`` with the lanes of a text: sixteen sums of digests, and 64 sums of signed units.

    Digests and pieces are made once, as columns of their own that all lanes refer to.
    """
    lines = F.split(F.col(text), "\n", -1)
    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))
    codes = 2 * SPARSE - 1
    made = df.select(
        "*",
        F.transform(lines, lambda p: F.sha2(p, 512)).alias("_digests"),
        # The lane of a piece, and its sign in the highest bit.
        F.transform(pieces, lambda p: F.xxhash64(p).bitwiseAND(codes).cast("int")).alias("_codes"),
    )

    def whole(k: int) -> Column:
        part = lambda d: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
        return F.aggregate("_digests", F.lit(0).cast("long"), lambda s, d: (s + part(d)) % (1 << WIDE_BITS))

    def units(k: int) -> Column:
        return F.size(F.filter("_codes", lambda c: c == k))

    lanes = [F.pmod(units(k) - units(k + SPARSE), F.lit(1 << SPARSE_BITS)) for k in range(SPARSE)]
    return made.select(
        *[F.col(c) for c in df.columns], F.array(*[whole(k) for k in range(WIDE)]).alias(wide), F.array(*lanes).alias(sparse)
    )


def combine(a: Column, b: Column, bits: int, sign: int = 1) -> Column:
    """Lanes of ``a`` with ``b`` inserted (sign 1) or deleted (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << bits)))


def signed(sparse: str) -> Column:
    """Sparse lanes as numbers around zero."""
    half, full = 1 << (SPARSE_BITS - 1), 1 << SPARSE_BITS
    return F.transform(F.col(sparse), lambda x: F.when(x >= half, x - full).otherwise(x).cast("double"))


def product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(equal: Column, both: str, own: str, other: str) -> Column:
    """1 for equal fingerprints, else the cosine of the sparse parts, 0 where it is negative or one is empty.

    The names are those of the products of the sparse parts: of the two, and of each with itself.
    """
    norm = F.sqrt(F.col(own) * F.col(other))
    cosine = F.when(norm > 0, F.col(both) / norm).otherwise(F.lit(0.0))
    return F.when(equal, F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def as_hex(wide: Column, sparse: Column) -> Column:
    """A fingerprint as 384 hexadecimal digits."""
    digits = lambda lanes, n: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(digits(wide, WIDE_BITS // 4), digits(sparse, SPARSE_BITS // 4))


def following(ids: DataFrame) -> tuple[DataFrame, bool]:
    """The next row of each distinct row (doc_id, row, n_chars) by (doc_id, row), the first after the last.

    Columns doc_id, row, n_chars, next_id, next_row; also whether rows repeat. Rows are dealt out by ranges
    and numbered by range, so that no task orders all of them; only the first rows of the ranges meet in one.
    """
    dealt = (
        ids.groupBy("doc_id", "row", "n_chars")
        .agg(F.count("*").alias("times"))
        .repartitionByRange("doc_id", "row")
        .withColumn("range", F.spark_partition_id())
    )
    kept = keep(dealt, "ranges").df
    within = Window.partitionBy("range").orderBy("doc_id", "row")
    here = F.struct("doc_id", "row")
    placed = kept.select(
        "*", F.lead(here).over(within).alias("next"), F.row_number().over(within).alias("place")
    )
    # One row a range.
    firsts = placed.where("place = 1").select(F.col("range").alias("range_"), here.alias("head"))
    ends = Window.orderBy("range_")
    heads = firsts.select(
        "range_", F.lead("head").over(ends).alias("after"),
        F.first("head").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"),
    )
    found = placed.join(F.broadcast(heads), F.col("range") == F.col("range_")).select(
        "doc_id", "row", "n_chars", F.coalesce("next", "after", "head").alias("next")
    )
    repeated = kept.agg(F.max("times")).first()[0]
    return found.select("doc_id", "row", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.row").alias("next_row")), (
        repeated or 0
    ) > 1


def edited_rows(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has its last quarter of code points replaced by as many, or all, of the start of the next
    document by (doc_id, hash of the row), the first after the last; a single document follows itself. A null
    text counts as empty and a null id comes first. Rows that repeat id and text count as one document in
    this order; each has its own row in the result.
    """
    rows = text_rows(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    links, repeated = following(rows.select("doc_id", "row", F.char_length("text").cast("long").alias("n_chars")))
    links = keep(links, "following").df
    # Null ids take part in the joins under the smallest number; the row hash keeps them apart from it.
    number = lambda c: F.coalesce(c, F.lit(-(2**63)))
    marked = with_lanes(rows.select("doc_id", "row", number(F.col("doc_id")).alias("id"), "text"), "text", "wide", "sparse")
    # What the document before each one takes from it.
    wanted = links.select(
        number(F.col("next_id")).alias("id"), F.col("next_row").alias("row"),
        number(F.col("doc_id")).alias("to_id"), F.col("row").alias("to_row"), "n_chars",
    )
    given = marked.join(wanted, ["id", "row"]).select(
        F.col("to_id").alias("id"), F.col("to_row").alias("row"), "n_chars",
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") / 4).cast("int")).alias("start"),
        F.col("wide").alias("next_wide"), F.col("sparse").alias("next_sparse"), F.col("doc_id").alias("next_doc_id"),
    )
    if repeated:
        given = given.dropDuplicates(["id", "row"])
    edited = marked.join(given, ["id", "row"]).select(
        "doc_id", "n_chars", "wide", "sparse", "next_wide", "next_sparse", "next_doc_id",
        F.concat(
            F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), "start"
        ).alias("edited"),
    )
    both = with_lanes(edited, "edited", "edited_wide", "edited_sparse")
    names = {"sparse": "s", "edited_sparse": "e", "next_sparse": "x"}
    both = both.select("*", *[signed(lanes).alias(name) for lanes, name in names.items()])
    pairs = [("s", "s"), ("e", "e"), ("x", "x"), ("s", "e"), ("s", "x")]
    both = both.select("*", *[product(a, b).alias(a + b) for a, b in pairs])
    same_edited = (F.col("wide") == F.col("edited_wide")) & (F.col("sparse") == F.col("edited_sparse"))
    same_next = (F.col("wide") == F.col("next_wide")) & (F.col("sparse") == F.col("next_sparse"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_hex(F.col("wide"), F.col("sparse")).alias("fingerprint"),
        as_hex(F.col("edited_wide"), F.col("edited_sparse")).alias("edited_fingerprint"),
        likeness(same_edited, "se", "ss", "ee").alias("near_edited"),
        likeness(same_next, "sx", "ss", "xx").alias("near_next"),
        "next_doc_id",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, wide, sparse per document: the lanes of its fingerprint. A null text counts as empty."""
    return with_lanes(text_rows(docs), "text", "wide", "sparse").select("doc_id", "wide", "sparse")
