"""Sinks: CSV, Parquet and JSON tables, and the two text exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import scalars as S


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV folder with a header in every file."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet folder.

    With ``partition_by`` the rows are first spread so that few tasks write to one
    partition, while a partition that holds most rows is split by adaptive execution.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "error", nan: str = "null") -> None:
    """JSON lines: infinities as the texts "Infinity" and "-Infinity", also inside arrays, maps and structs.

    NaN is written as null, or as the text "NaN" with ``nan="text"``; only then :func:`read_json` gives it back.
    Fields that are null are written, so every line has all fields.
    """
    if nan not in ("null", "text"):
        raise ValueError(f"nan is 'null' or 'text', not {nan!r}")
    rows = S.nan_to_null(df) if nan == "null" else df
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What :func:`write_json` wrote, under the schema of the written table; the texts of numbers become numbers.

    A line that is no JSON, or holds a value of another type, is an error.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", True).json(path)


def confirmed_rows(vetted: DataFrame) -> DataFrame:
    """Confirmed objects as text: name, status, confidence in percent, period and radius."""
    texts = (
        F.col("name"),
        F.col("original_status"),
        S.percent_text(F.col("confidence"), 1),
        S.fixed_text(F.col("characteristics.period"), 3, "N/A"),
        S.fixed_text(F.col("characteristics.radius"), 2, "N/A"),
    )
    return vetted.filter("confirmable").select(*[t.alias(n) for t, n in zip(texts, fv.CONFIRMED_EXPORT_HEADER)])


def score_rows(results: DataFrame) -> DataFrame:
    """Results as text with class group 1 confirmed, 2 candidates, 3 false positives."""
    names = list(fv.EXPORT_CLASS_TEXT)
    text = F.create_map(*[F.lit(x) for pair in fv.EXPORT_CLASS_TEXT.items() for x in pair])
    values = (F.col("tic_id"), F.element_at(text, F.col("result")), S.fixed_text(F.col("score"), 3))
    known = results.filter(F.col("result").isin(*names))
    return known.select(
        F.array_position(F.array(*[F.lit(n) for n in names]), F.col("result")).cast("int").alias("class_group"),
        *[v.alias(n) for v, n in zip(values, fv.SCORE_EXPORT_HEADER)],
    )


def export_confirmed(vetted: DataFrame, path: str) -> None:
    """Write :func:`confirmed_rows` as CSV."""
    write_csv(confirmed_rows(vetted), path)


def export_scores(results: DataFrame, path: str) -> None:
    """Write :func:`score_rows` as CSV in class order, by target within a class."""
    ordered = score_rows(results).orderBy("class_group", fv.SCORE_EXPORT_HEADER[0])
    write_csv(ordered.drop("class_group"), path)
