"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.plans.registered import table
from skysift.session import bound_batches, shared_dir

__all__ = [
    "Kept", "Recent", "free_name", "in_batches", "keep", "order_key", "picked", "row_key", "same", "table", "text_rows", "with_fields",
]


class Recent[K, V](dict[K, V]):
    """Results of a function, for a Python worker that meets the same small things again and again.

    When ``entries`` are held, those not asked for since the last such turn are forgotten, so twice as many stay at most
    and frequent ones stay for good. Keys longer than ``longest`` are never held. The bounds are ones on memory: what
    was forgotten is made again.
    """

    def __init__(self, make: Callable[[K], V], entries: int, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key: K) -> V:
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@dataclass(frozen=True)
class Kept:
    """A table written to the shared folder: its rows outlive lost executors."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Remove the files; only for tables that no later plan reads."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether the shuffle files of a statement go when it ends. A written table is read back, so nobody asks for them again.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str) -> Kept:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    return Kept(spark.read.schema(df.schema).parquet(path), path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a document by its id and text. Equal rows share a key, and no other rows do."""
    return F.md5(
        F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))
    )


def order_key(doc_id: Column, position: Column, below: int = 2**40) -> Column:
    """One sortable number for (doc_id, position); a null id comes before all others.

    A decimal keeps the minimum in a hash aggregate, where a struct would need sorted rows.
    """
    at = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    return (at * F.lit(below).cast("decimal(13,0)") + position.cast("decimal(13,0)")).cast("decimal(38,0)")


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns doc_id (long) and text (null as empty) of a table with any further columns."""
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )


def same(a: Column, b: Column) -> Column:
    """Equality that also holds between nulls."""
    return a.eqNullSafe(b)


def in_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` over bounded batches. Sets the session's batch size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def picked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Some columns of ``df`` by their exact names."""
    return df.select(*[F.col(f"`{c}`") for c in names])


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` with further fields."""
    return T.StructType([*df.schema.fields, *fields])
