"""Catalogue formats: detection, label column, report and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..sources import catalog
from .profile import numeric_columns, value_counts


def detect_format(columns: Sequence[str]) -> str | None:
    """First known format whose key columns are all present."""
    return next((name for name, f in fv.FORMATS.items() if set(f.key_columns) <= set(columns)), None)


def detect_strict(columns: Sequence[str]) -> tuple[str | None, list[str]]:
    """Format that also shows a label column, and the required columns it still lacks."""
    present = set(columns)
    for f in fv.FORMATS.values():
        if set(f.key_columns) <= present and present & set(f.label_columns):
            return f.strict_name, [c for c in f.strict_columns if c not in present]
    return None, []


def label_column(df: DataFrame, format_name: str | None) -> str | None:
    """First label column of the format that holds any value."""
    if format_name not in fv.FORMATS:
        return None
    present = [c for c in fv.FORMATS[format_name].label_columns if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"any{i}") for i, c in enumerate(present)]).first()
    return next((c for i, c in enumerate(present) if row[f"any{i}"]), None)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(value, count) of the labels; empty when the column is absent."""
    if label not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, count bigint")
    return value_counts(df, label)


REPORT_SCHEMA = (
    "is_valid boolean, format string, format_name string, label_column string, has_labels boolean, "
    "label_distribution map<string,bigint>, planet_name_column string, total_rows bigint, total_columns int, "
    "columns array<string>, numeric_columns array<string>, documentation string, expected_labels array<string>, "
    "unexpected_labels array<string>, errors array<string>"
)
# Rows without a label, in the distribution of a report.
NO_LABEL = "null"


def catalog_report(df: DataFrame) -> DataFrame:
    """One row: format, label column and its distribution, sizes, numeric columns and errors."""
    spark = df.sparkSession
    name = detect_format(df.columns)
    if name is None:
        wanted = ", ".join(f"{n} ({' + '.join(f.key_columns)})" for n, f in fv.FORMATS.items())
        row = (False, *[None] * 13, [f"unknown format; known formats: {wanted}"])
        return spark.createDataFrame([row], REPORT_SCHEMA)
    f = fv.FORMATS[name]
    label = label_column(df, name)
    errors = [] if f.object_column in df.columns else [f"missing object column: {f.object_column}"]
    kinds = F.lit(None).cast("string") if label is None else F.coalesce(F.col(f"`{label}`").cast("string"), F.lit(NO_LABEL))
    counts = df.groupBy(kinds.alias("value")).agg(F.count("*").alias("count"))
    # One entry a label, however many there are: it is what the report shows.
    listed = F.map_from_entries(F.collect_list(F.struct("value", "count")))
    whole = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        listed.alias("shown") if label is not None else F.expr("map()").cast("map<string,bigint>").alias("shown"),
    )
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    unexpected = F.array_sort(F.filter(F.map_keys("shown"), lambda k: ~k.isin(*f.expected_labels, NO_LABEL)))
    values = [
        F.lit(not errors), F.lit(name), F.lit(f.title), F.lit(label), F.lit(label is not None), F.col("shown"),
        F.lit(f.object_column), F.col("total"), F.lit(len(df.columns)), texts(df.columns), texts(numeric_columns(df)),
        F.lit(f.documentation), texts(f.expected_labels), unexpected, texts(errors),
    ]
    fields = T.StructType.fromDDL(REPORT_SCHEMA).fields
    return whole.select(*[v.cast(x.dataType).alias(x.name) for v, x in zip(values, fields)])


def label_counts(df: DataFrame, label: str, most: int | None = None) -> dict[object, int]:
    """Rows per label, null included, on the driver; ValueError beyond ``most`` different labels."""
    rows = value_counts(df, label)
    found = (rows if most is None else rows.limit(most + 1)).collect()
    if most is not None and len(found) > most:
        raise ValueError(f"{label} has more than {most} different values")
    return {r["value"]: r["count"] for r in found}


def prepare_catalog(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without '#' rows, and its report."""
    clean = catalog.drop_hash_rows(df)
    return clean, catalog_report(clean)


def is_empty(df: DataFrame) -> bool:
    """True for a table without rows."""
    return df.isEmpty()


FINDING_SCHEMA = "severity string, check string, detail string"


def standard_checks(df: DataFrame, for_training: bool = False) -> DataFrame:
    """Findings (severity, check, detail) on the standardised columns; errors make a table unusable."""
    spark = df.sparkSession
    required = [*fv.STANDARD_COLUMNS, *([fv.STANDARD_LABEL] if for_training else [])]
    missing = [c for c in required if c not in df.columns]
    present = [c for c in fv.STANDARD_COLUMNS if c in df.columns]
    row = df.agg(
        F.count("*").alias("total"), *[F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(present)]
    ).first()
    found = []
    if missing:
        found.append(("error", "missing_columns", ", ".join(missing)))
    if row["total"] == 0:
        found.append(("error", "no_rows", "0"))
    elif for_training and row["total"] < fv.FEW_TRAINING_ROWS:
        found.append(("warning", "few_rows", str(row["total"])))
    found += [("warning", "null_values", f"{c}: {row[f'n{i}']}") for i, c in enumerate(present) if row[f"n{i}"]]
    findings = spark.createDataFrame(found, FINDING_SCHEMA)
    if for_training and fv.STANDARD_LABEL in df.columns:
        bad = unexpected_labels(df, fv.STANDARD_LABEL, fv.STANDARD_LABEL_VALUES)
        findings = findings.unionByName(
            bad.select(
                F.lit("error").alias("severity"),
                F.lit("invalid_label").alias("check"),
                F.concat_ws(": ", F.col("value"), F.col("count").cast("string")).alias("detail"),
            )
        )
    return findings


def _missing(df: DataFrame, name: str) -> Column:
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.col(name).isNull() | F.isnan(name) if floating else F.col(name).isNull()


def training_check(df: DataFrame) -> DataFrame:
    """One row: usable, rows, columns, class_distribution, errors and warnings of a table to train on.

    A table with an error among its findings is not usable.
    """
    findings = standard_checks(df, for_training=True)
    lists = findings.agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("severity") == kind, F.concat_ws(": ", "check", "detail")))).alias(f"{kind}s")
            for kind in ("error", "warning")
        ]
    )
    label = fv.STANDARD_LABEL if fv.STANDARD_LABEL in df.columns else None
    value = F.lit(NO_LABEL) if label is None else F.coalesce(F.col(label).cast("string"), F.lit(NO_LABEL))
    kinds = df.groupBy(value.alias("value")).agg(F.count("*").alias("count")).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("class_distribution"),
    )
    verdict = lists.select(F.struct("errors", "warnings")).scalar().alias("verdict")
    return kinds.select("*", verdict).select(
        (F.size("verdict.errors") == 0).alias("usable"), "rows", F.lit(len(df.columns)).alias("columns"),
        "class_distribution", "verdict.errors", "verdict.warnings",
    )


def unexpected_labels(df: DataFrame, label: str, allowed: Sequence[str]) -> DataFrame:
    """(value, count) of the labels outside the allowed ones; null is not reported."""
    return value_counts(df.filter(~F.col(f"`{label}`").isin(*allowed)), label)


def row_shape(
    lines: DataFrame, fields: int | Column | None = None, sep: str = ",", tolerated: float = 0.1,
    first_n: int | None = None, order_by: Sequence[str] = (),
) -> DataFrame:
    """One row: data lines, lines with a wrong field count, and whether the text is usable.

    ``fields`` is the expected count, taken from the header when absent; the header is then
    left out of the lines. Every line is checked, or the first ``first_n`` by ``order_by``; a text is usable
    if at most the share ``tolerated`` of them is wrong.
    """
    body = catalog.data_lines(lines)
    if first_n is not None:
        if not order_by:
            raise ValueError("the first lines need an order")
        body = body.orderBy(*order_by).limit(first_n)
    if fields is None:
        header = catalog.first_line(lines)
        body, fields = body.filter(F.col("value") != header), len(catalog.split_header(header, sep))
    count = F.size(F.split("value", f"[{sep}]", -1))
    shape = body.agg(F.count("*").alias("rows"), F.count_if(count != fields).alias("wrong_rows"))
    return shape.withColumn("is_valid", (F.col("rows") >= 1) & (F.col("wrong_rows") <= F.col("rows") * tolerated))


def check_header(header: str, sep: str = ",") -> dict[str, object]:
    """Strict verdict on a header line: format, validity and the columns it lacks."""
    name, missing = detect_strict(catalog.split_header(header, sep))
    return {"format": name or "unknown", "is_valid": name is not None and not missing, "missing": missing}


def object_name_column(df: DataFrame) -> str:
    """First known object-name column, or ValueError."""
    found = next((c for c in fv.OBJECT_COLUMNS if c in df.columns), None)
    if found is None:
        raise ValueError(f"no object column; expected one of {list(fv.OBJECT_COLUMNS)}")
    return found


def find_object(df: DataFrame, name: str, order_by: Sequence[str] = (), column: str | None = None) -> DataFrame:
    """At most one row: the first object of that name, by ``order_by`` or by the whole row."""
    column = column or object_name_column(df)
    field = df.schema[column].dataType
    value = F.col(f"`{column}`")
    # Text is compared as it is, so that the filter reaches the scan.
    match = value == name if isinstance(field, T.StringType) else value.cast("string") == name
    keys = list(order_by) or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.filter(match).orderBy(*[F.col(f"`{k}`") for k in keys]).limit(1)


def object_details(df: DataFrame, name: str) -> dict[str, object]:
    """The first object of that name as a dict without NaN; KeyError when there is none."""
    row = find_object(df, name).first()
    if row is None:
        raise KeyError(name)
    return {k: None if isinstance(v, float) and v != v else v for k, v in row.asDict(recursive=True).items()}
