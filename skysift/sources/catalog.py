"""Catalogue text: comment lines, headers, type inference and tolerant cells, all as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import stage

# Different columns of all files that are read together; more than these point to files without a header.
MAX_COLUMNS = 10_000
# Appended as a last field, it shows where a line really ends.
_END = "\u0002"


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines as column ``value``; bytes that are not UTF-8 are replaced, not refused."""
    return spark.read.text(path)


def read_file_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines as (value, file, place); the place orders the lines of a file."""
    within = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), within.alias("place"))


def is_comment(line: Column) -> Column:
    """True for a line whose first visible character is '#'."""
    return line.rlike(r"^\s*#")


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither comments nor blank."""
    return lines.filter(~is_comment(F.col("value")) & F.col("value").rlike(r"\S"))


def split_header(header: str, sep: str = ",") -> list[str]:
    """Column names of a header line."""
    text = header.removeprefix("﻿").rstrip("\r\n")
    return [name.strip().strip('"') for name in text.split(sep)]


def first_line(lines: DataFrame) -> str:
    """The header: first line that is neither comment nor blank."""
    row = data_lines(lines).select("value").first()
    if row is None:
        raise ValueError("no data: every line is blank or a comment")
    return row["value"]


def parse_lines(
    lines: DataFrame,
    header: str | None = None,
    sep: str = ",",
    drop_long_lines: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Lines to string columns named by the header; repeated header lines are left out.

    A line with too few fields gets nulls. A line with too many keeps its first
    fields, or is dropped with ``drop_long_lines``. Columns of ``lines`` named in ``carry`` follow the cells.
    """
    header = header if header is not None else first_line(lines)
    names = split_header(header, sep)
    if len(set(names)) != len(names):
        raise ValueError(f"repeated column names: {sorted({n for n in names if names.count(n) > 1})}")
    body = data_lines(lines).filter(F.col("value") != header)
    text, width = F.col("value"), len(names)
    if drop_long_lines:
        text, width = F.concat(text, F.lit(sep + _END)), width + 1
    cells = ", ".join(f"c{i} string" for i in range(width))
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = body.select(F.from_csv(text, cells, options).alias("cells"), *carry)
    found = [F.col(f"cells.c{i}") for i in range(width)]
    if drop_long_lines:
        parsed = parsed.filter(F.array_contains(F.array(*found), _END))
    return parsed.select(*[F.when(~c.isin("", _END), c).alias(n) for c, n in zip(found, names)], *carry)


def _headers(lines: DataFrame, sep: str) -> DataFrame:
    """(file, header, names) of every file with data, one row a file: the names of its columns in their order."""
    by_file = data_lines(lines).groupBy("file").agg(F.min_by("value", "place").alias("header"))
    text = F.rtrim(F.regexp_replace("header", "^\ufeff", ""), F.lit("\r\n"))
    cells = F.split(text, "\\Q" + sep + "\\E", -1)
    return by_file.withColumn("names", F.transform(cells, lambda c: F.btrim(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit('"'))))


def parse_files(
    lines: DataFrame, sep: str = ",", drop_long_lines: bool = False, carry: Sequence[str] = (), max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Lines of several files to string columns, each file under its own header.

    ``lines`` has (value, file, place). Columns are matched by name; a column that a file lacks is null. Columns stand in
    the order of the first header, by text, that names them. One scan finds the header of every file, one row a file
    in a table that is written once; a second one splits every line once and takes its cells by the places that its
    file's header gives them, so two scans do for any number of headers. The driver sees the names of the columns,
    of which ``max_columns`` are allowed in all files together.
    """
    headers = stage(_headers(lines, sep), "headers")
    different = headers.select("header").distinct().limit(2).collect()
    if not different:
        raise ValueError("no data: every line is blank or a comment")
    if len(different) == 1:
        return parse_lines(lines, different[0]["header"], sep, drop_long_lines, carry)
    bad = headers.where(F.size("names") != F.size(F.array_distinct("names"))).select("header", "file").first()
    if bad is not None:
        raise ValueError(f"repeated column names in the header of {bad['file']}: {bad['header']}")
    first = headers.select("header", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min(F.struct("header", "at")).alias("first"))
    names = [r["name"] for r in first.orderBy("first").select("name").limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} different columns; do all files have a header?")
    width = headers.agg(F.max(F.size("names")).alias("width")).first()["width"]
    places = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("names", n).cast("int"))
    own = headers.select("file", F.col("header").alias("__header"), F.size("names").alias("__width"), places.alias("__places"))
    body = data_lines(lines).join(own, "file").filter(F.col("value") != F.col("__header"))
    # With the mark as a last field, a line's cells are those before it; without, a longer line keeps its first fields.
    cells = ", ".join(f"c{i} string" for i in range(width + 1))
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxColumns": str(max(20480, width + 2))}
    split = F.from_csv(F.concat("value", F.lit(sep + _END)), cells, options).alias("__cells")
    listed = F.array(*[F.col(f"__cells.c{i}") for i in range(width + 1)]).alias("__cells")
    kept = ["__width", "__places", *carry]
    # The one-element explode keeps the line from being split anew for each of its columns.
    parsed = body.select(split, *kept).select(F.explode(F.array(listed)).alias("__cells"), *kept)
    if drop_long_lines:
        parsed = parsed.filter(F.array_position("__cells", _END).between(1, F.col("__width") + 1))
    found = [F.get("__cells", F.get("__places", F.lit(i)) - 1) for i in range(len(names))]
    return parsed.select(*[F.when(~c.isin("", _END), c).alias(n) for c, n in zip(found, names)], *carry)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of every string column from all of its cells: bigint, double, boolean or string.

    One scan, whatever the number of columns. A column without any value stays string.
    """
    if not df.columns:
        return {}
    kinds = ("bigint", "double", "boolean")
    cells = [F.struct(F.lit(n).alias("name"), F.trim(F.col(f"`{n}`")).alias("cell")) for n in df.columns]
    cell = F.col("cell")
    seen = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("cell is not null").groupBy("name").agg(
        F.count("*").alias("filled"),
        F.count(F.when(cell.rlike(r"^[+-]?\d+$"), cell.try_cast("bigint"))).alias("bigint"),
        F.count(_plain_double(cell)).alias("double"),
        F.count_if(F.lower(cell).isin("true", "false")).alias("boolean"),
    )
    found = {r["name"]: next((k for k in kinds if r[k] == r["filled"]), "string") for r in seen.collect()}
    return {n: found.get(n, "string") for n in df.columns}


def _plain_double(cell: Column) -> Column:
    # Spark also reads '1d' and '1f' as numbers; a catalogue means text by them.
    return F.when(~cell.rlike(r"[dDfF]$") | F.lower(cell).isin("inf", "-inf"), cell.try_cast("double"))


def cast_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast string columns; a cell that does not fit its type becomes null, and so does NaN."""
    columns = []
    for name in df.columns:
        cell, kind = F.col(f"`{name}`"), types.get(name, "string")
        if kind == "double":
            cell = S.valid_double(_plain_double(F.trim(cell)))
        elif kind != "string":
            cell = F.trim(cell).try_cast(kind)
        columns.append(cell.alias(name))
    return df.select(*columns)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The same frame, or ValueError naming the columns it lacks."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def catalog_from_lines(
    lines: DataFrame,
    required: Sequence[str] = (),
    types: dict[str, str] | None = None,
    sep: str = ",",
    header: str | None = None,
    drop_long_lines: bool = False,
) -> DataFrame:
    """Catalogue lines to a typed table with all original columns.

    With ``types`` nothing is inferred and the text is read once.
    """
    cells = require_columns(parse_lines(lines, header, sep, drop_long_lines), required)
    return cast_cells(cells, infer_types(cells) if types is None else types)


def read_catalog(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """Catalogue files with '#' comment lines, each under its own header; columns are matched by name.

    Options as in :func:`catalog_from_lines`; with ``header`` the files have none of their own, or this one.
    """
    if options.get("header") is not None:
        return catalog_from_lines(read_lines(spark, path), **options)
    required, types = options.pop("required", ()), options.pop("types", None)
    options.pop("header", None)
    cells = require_columns(parse_files(read_file_lines(spark, path), **options), required)
    return cast_cells(cells, infer_types(cells) if types is None else types)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
    sep: str = ",",
) -> DataFrame:
    """Plain CSV with a header; a schema saves the inference pass, ``columns`` prunes the scan. NaN becomes null."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return S.nan_to_null(df.select(*columns) if columns else df)


def read_columns(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan, projected; NaN becomes null."""
    df = spark.read.parquet(path)
    return S.nan_to_null(df.select(*columns) if columns else df)


def read_batches(spark: SparkSession, folder: str, schema: str | T.StructType | None = None) -> DataFrame:
    """All ``batch_*.csv`` of a folder as one table, each row with its file name.

    Every file is read under its own header and columns are matched by name; a column that a file lacks is null.
    With a schema its columns are returned, else all columns with inferred types.
    """
    lines = read_file_lines(spark, f"{folder.rstrip('/')}/batch_*.csv")
    cells = parse_files(lines, carry=["file"])
    names = [n for n in cells.columns if n != "file"]
    if schema is None:
        types = infer_types(cells.drop("file"))
    else:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        types = {f.name: f.dataType.simpleString() for f in fields}
        cells = cells.withColumns({f.name: F.lit(None).cast("string") for f in fields if f.name not in names})
        names = [f.name for f in fields]
    typed = cast_cells(cells.select(*[F.col(f"`{n}`") for n in names], "file"), types)
    return typed.select(*[F.col(f"`{n}`") for n in names], F.element_at(F.split("file", "/"), -1).alias("batch_file"))


def concat_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns; absent columns are null."""
    if not frames:
        raise ValueError("nothing to concatenate")
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def drop_hash_rows(df: DataFrame, marker: str = "#") -> DataFrame:
    """Drop rows whose first column, if text, starts with the marker or is null."""
    first = df.schema.fields[0]
    if not isinstance(first.dataType, T.StringType):
        return df
    return df.filter(~F.col(f"`{first.name}`").startswith(marker))
