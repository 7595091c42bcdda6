"""Column expressions: text parsing, score classes, labels, null rules and formatted numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv

# Ranks after every known label code.
UNKNOWN_RANK = 99
# Sampling keys are below this.
SAMPLING_KEYS = 2**52


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    """A regex group, or null where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


# --- file names, scripts and identifiers -------------------------------------------------


def tic_from_name(name: Column) -> Column:
    """Target id in a light-curve or validation file name."""
    return _group(name, fv.TIC_PATTERN).try_cast("bigint")


def sector_from_name(name: Column) -> Column:
    """Sector number in a file name."""
    return _group(name, fv.SECTOR_PATTERN).try_cast("int")


def url_in_line(line: Column) -> Column:
    """First https URL of a line."""
    return _group(line, fv.URL_PATTERN)


def fits_name_in_url(url: Column) -> Column:
    """Name of the FITS file a URL points to."""
    return _group(url, fv.FITS_NAME_PATTERN)


def base_name(url: Column) -> Column:
    """Last path segment of a URL or path, without query or fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.element_at(F.split(path, "/"), -1)


def sector_run(sector: Column) -> Column:
    """Run text of a single sector: 6 becomes '6-6'."""
    return F.format_string("%d-%d", sector, sector)


def parse_sector_run(run: Column) -> Column:
    """First and last sector of '6-6', '1-39' or 's0001-s0013' as a struct; nulls where unreadable."""
    pattern = r"^\s*s?(\d+)-s?(\d+)\s*$"
    return F.struct(
        _group(run, pattern, 1).try_cast("int").alias("first_sector"),
        _group(run, pattern, 2).try_cast("int").alias("last_sector"),
    )


def number_token(token: Column) -> Column:
    """A token of free text as double; null unless it is a plain number."""
    return F.when(token.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), token.try_cast("double"))


def pair_by_position(ids: Column, sectors: Column) -> Column:
    """Pairs (id, sector) of two arrays of equal length; null where the lengths differ."""
    zipped = F.arrays_zip(ids.alias("id"), sectors.alias("sector"))
    pairs = F.transform(zipped, lambda z: F.struct(z["id"].alias("id"), z["sector"].alias("sector")))
    return F.when(F.size(ids) == F.size(sectors), pairs)


def with_column_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters read instead of computing it again.

    A filter on a plain column moves below the projection and takes a copy of the
    expression along; a chain of regex steps would grow with every step.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


# --- scores and labels -------------------------------------------------------------------


def score_class(score: Column) -> Column:
    """Result text of a score; a missing score, or NaN, has no class."""
    return (
        F.when(valid_double(score).isNull(), F.lit(None).cast("string"))
        .when(score <= fv.FALSE_POSITIVE_MAX, fv.FALSE_POSITIVE)
        .when(score <= fv.CANDIDATE_MAX, fv.CANDIDATE)
        .otherwise(fv.CONFIRMED)
    )


def label_rank(code: Column) -> Column:
    """Position of a label code in the priority list; unknown codes rank last, null stays null."""
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(fv.LABEL_PRIORITY) for x in (c, i)])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(ranks, code), F.lit(UNKNOWN_RANK)))


def better_label(left: Column, right: Column) -> Column:
    """The label of higher priority; a null side loses and the left side wins a tie."""
    right_wins = left.isNull() | (label_rank(right) < label_rank(left))
    return F.when(right_wins, right).otherwise(left)


def label_name(code: Column) -> Column:
    """Long name of a label code; an unknown code is kept."""
    names = F.create_map(*[F.lit(x) for pair in fv.LABEL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def is_confirmable(
    label: Column,
    confidence: Column,
    labels: Sequence[str] = fv.CONFIRMABLE_LABELS,
    above: float = fv.CONFIRMABLE_ABOVE,
) -> Column:
    """True for a confirmed label with confidence strictly above the bound, never null; NaN confirms nothing."""
    return F.coalesce(label.isin(*labels) & (valid_double(confidence) > above), F.lit(False))


def label_scores(labels: Sequence[str], scores: Column) -> Column:
    """Map from label to score, given the scores as an array in label order."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), scores)


# --- nulls and NaN -----------------------------------------------------------------------


def valid_double(column: Column) -> Column:
    """The value as double, null when missing, NaN or not a number."""
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def first_valid(df: DataFrame, names: Sequence[str]) -> Column:
    """First usable value of the columns that exist, as double."""
    present = [valid_double(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def characteristics(df: DataFrame) -> Column:
    """Period, duration, depth and radius of an object, each from its first usable alias column."""
    return F.struct(*[first_valid(df, names).alias(key) for key, names in fv.CHARACTERISTIC_COLUMNS.items()])


def _without_nan(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.ArrayType) and _has_float(kind):
        return F.transform(value, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, T.MapType) and _has_float(kind.valueType):
        return F.transform_values(value, lambda _, v: _without_nan(v, kind.valueType))
    if isinstance(kind, T.StructType) and _has_float(kind):
        fields = [_without_nan(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every float, also inside arrays, maps and structs."""
    changed = {
        f.name: _without_nan(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if _has_float(f.dataType)
    }
    return df.withColumns(changed) if changed else df


# --- formatted numbers, times and sizes --------------------------------------------------


def percent_text(value: Column, digits: int = 1) -> Column:
    """0.875 becomes '87.5%'."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", value.cast("double") * 100))


def fixed_text(value: Column, digits: int = 2, missing: str | None = None) -> Column:
    """A number with fixed decimals, or the given text where it is missing."""
    text = F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))
    return F.coalesce(text, F.lit(missing)) if missing is not None else text


def size_mb(size: Column) -> Column:
    """Bytes as megabytes with two decimals."""
    return F.round(size / F.lit(1024 * 1024), 2)


def sampling_key(columns: Sequence[Column], seed: int) -> Column:
    """A 52-bit number, exact also as double, that depends only on the values and the seed.

    It is cut from an MD5 digest, so another system can draw the same sample.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
