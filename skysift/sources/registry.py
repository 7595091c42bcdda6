"""Registries of datasets and jobs: one JSON document per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..functions import scalars as S

_BAD = "_corrupt_record"

DATASET_SCHEMA = (
    "id string, filename string, upload_date string, format string, format_name string, rows bigint, "
    "columns bigint, has_labels boolean, label_column string, label_distribution map<string,bigint>, "
    "planet_name_column string, numeric_columns array<string>, documentation string, "
    "expected_labels array<string>, path string"
)
JOB_SCHEMA = (
    "analysis_id string, filename string, created_at string, status string, input_csv string, output_dir string, "
    "started_at string, completed_at string, duration_seconds double, progress int, "
    "info struct<total_tics: bigint, columns: array<string>, tic_ids: array<bigint>, sectors: array<string>>"
)


def parse_entries(documents: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """The fields of a JSON document in each row's text, behind the other columns, and what is wrong with it as ``problem``.

    problem: null, ``empty`` (null or blank), ``not an object``, or ``unreadable`` (not JSON, or a field of another
    type than the schema's); the fields of such a row are null. Every text is parsed once, and no row is left out:
    ``problem is null`` are the entries, the others the documents to look at. Fields that are not in the schema are ignored.
    """
    fields = T.StructType.fromDDL(schema)
    parsed = T.StructType([*fields.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    rest = [F.col(f"`{c}`") for c in documents.columns if c != text]
    value = F.col(f"`{text}`")
    read = S.with_column_once(documents, "__entry", F.struct(F.from_json(value, parsed, options).alias("e")))
    problem = (
        F.when(F.coalesce(F.trim(F.regexp_replace(value, r"\s", " ")), F.lit("")) == "", "empty")
        .when(~value.rlike(r"^\s*\{"), "not an object")
        .when(F.col("__entry.e").isNull() | F.col(f"__entry.e.{_BAD}").isNotNull(), "unreadable")
    )
    judged = read.withColumn("problem", problem)
    kept = [F.when(F.col("problem").isNull(), F.col(f"__entry.e.`{f.name}`")).alias(f.name) for f in fields.fields]
    return judged.select(*rest, *kept, "problem")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(document, value) of all ``*_metadata.json`` of a folder: name and whole text; no document gives no row."""
    pattern = f"{folder.rstrip('/')}/*_metadata.json"
    fs, path = session.file_system(spark, pattern)
    if not fs.globStatus(path):
        return spark.createDataFrame([], "document string, value string")
    whole = spark.read.text(pattern, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("document"), "value")


def read_registry(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``*_metadata.json`` of a folder; unreadable documents are left out, :func:`broken_documents` lists them."""
    found = parse_entries(read_documents(spark, folder), schema)
    return found.filter("problem is null").drop("document", "problem")


def broken_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(document, problem) of the documents that :func:`read_registry` leaves out."""
    return parse_entries(read_documents(spark, folder), schema).filter("problem is not null").select("document", "problem")
