"""Profile of a table: missing values, distributions, outliers, duplicates, balance and correlations.

The columns are turned into (column, value) cells and grouped by column, so an analysis is one scan of the
table, however many columns it has. NaN counts as missing throughout.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import scalars as S
from . import quantiles


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in table order; Boolean is not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, max_unique: int = 50) -> list[str]:
    """Text and Boolean columns with at most ``max_unique`` distinct values; null counts as one value."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    if not names:
        return []
    # A sketch settles the clear cases; only columns near the bound are counted exactly.
    row = df.agg(*[_c_distinct_sketch(n).alias(f"d{i}") for i, n in enumerate(names)]).first()
    near = [n for i, n in enumerate(names) if row[f"d{i}"] <= 2 * max_unique + 10]
    if not near:
        return []
    exact = _column_values(df, near).groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") <= max_unique)
    kept = {r["column"] for r in exact.collect()}
    return [n for n in near if n in kept]


def _c_distinct_sketch(name: str) -> Column:
    return F.approx_count_distinct(_c(name), 0.02) + F.max(_c(name).isNull().cast("int"))


def _column_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct (column, value, value_count) of the named columns, values as text."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), _c(n).cast("string").alias("value")) for n in names]))
    long = df.select(cells.alias("cell")).select("cell.column", "cell.value")
    return long.groupBy("column", "value").agg(F.count("*").alias("value_count"))


def _cells(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """(column, value) of every row and column, one type for all values; nulls are kept."""
    cells = [F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in values.items()]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def _numbers(names: Sequence[str]) -> dict[str, Column]:
    return {n: S.valid_double(_c(n)) for n in names}


def _usable(df: DataFrame, name: str) -> Column:
    """Whether a cell holds a value; NaN is none."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return _c(name).isNotNull() & ~F.isnan(_c(name)) if floating else _c(name).isNotNull()


def _for_columns(df: DataFrame, names: Sequence[str], grouped: DataFrame, zero: Mapping[str, Column]) -> DataFrame:
    """A row for each column, also where the table has no rows; ``zero`` gives the values then."""
    titles = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    # One row a column on both sides.
    joined = titles.join(grouped, "column", "left")
    return joined.select("column", *[F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c) for c in grouped.columns if c != "column"])


def schema_and_missing(df: DataFrame) -> DataFrame:
    """(column, dtype, null_count, null_pct) of every column; the share of an empty table is 0."""
    names = df.columns
    missing = F.count_if(~F.col("value"))
    grouped = _cells(df, {n: _usable(df, n) for n in names}).groupBy("column").agg(
        missing.alias("null_count"), F.try_divide(missing, F.count("*")).alias("null_pct")
    )
    rows = _for_columns(df, names, grouped, {"null_count": F.lit(0).cast("bigint"), "null_pct": F.lit(0.0)})
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return rows.select("column", F.try_element_at(kinds, F.col("column")).alias("dtype"), "null_count", "null_pct")


_STATS = {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"}


def _grouped_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, max, variance, rows) of the numeric columns, in one scan."""
    value = F.col("value")
    return _cells(df, _numbers(names)).groupBy("column").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.var_samp(value).alias("variance"), F.count("*").alias("rows"),
    )


def _statistics(df: DataFrame, names: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """The plain statistics of every column, on the driver: one row a column."""
    found = {n: {k: 0 if k == "count" else None for k in _STATS} for n in names}
    if names:
        for r in _grouped_statistics(df, names).collect():
            found[r["column"]] = {k: r[k] for k in _STATS}
    return found


def numeric_distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, max and the profile quantiles of each numeric column."""
    names = list(columns) if columns is not None else numeric_columns(df)
    labels = [f"q{int(q * 100):02d}" for q in fv.PROFILE_QUANTILES]
    schema = "column string, " + ", ".join(f"{k} {v}" for k, v in _STATS.items())
    schema += ", " + ", ".join(f"{q} double" for q in labels)
    stats = _statistics(df, names)
    inner = [q for q in fv.PROFILE_QUANTILES if 0 < q < 1]
    counts = {n: s["count"] for n, s in stats.items()}
    found = quantiles.exact_quantiles(df, names, inner, counts)
    rows = [(n, *stats[n].values(), stats[n]["min"], *found[n], stats[n]["max"]) for n in names]
    return df.sparkSession.createDataFrame(rows, schema)


Bounds = tuple[float | None, float | None]


def iqr_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, Bounds]:
    """Lower and upper outlier bound of each column; null bounds for a column without values."""
    return {n: bounds_of(*q) for n, q in quantiles.exact_quantiles(df, columns, (0.25, 0.75)).items()}


def bounds_of(q1: float | None, q3: float | None) -> Bounds:
    """Outlier bounds of two quartiles."""
    return (None, None) if q1 is None or q3 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))


def is_outlier(value: Column, lower: float | None, upper: float | None) -> Column:
    """Strictly outside the bounds; false where a bound or the value is missing."""
    if lower is None or upper is None:
        return F.lit(False)
    return F.coalesce((value < F.lit(lower)) | (value > F.lit(upper)), F.lit(False))


def outliers_iqr(
    df: DataFrame, columns: Sequence[str] | None = None, bounds: Mapping[str, Bounds] | None = None
) -> DataFrame:
    """(column, lower, upper, outliers, outlier_pct); the share is of all rows.

    Bounds known from :func:`numeric_distributions` save the scans that look for them.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    schema = "column string, lower double, upper double, outliers bigint, outlier_pct double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    bounds = iqr_bounds(df, names) if bounds is None else bounds
    outside = {n: is_outlier(v, *bounds[n]) for n, v in _numbers(names).items()}
    grouped = _cells(df, outside).groupBy("column").agg(
        F.count_if("value").alias("outliers"), F.try_divide(F.count_if("value"), F.count("*")).alias("outlier_pct")
    )
    rows = _for_columns(df, names, grouped, {"outliers": F.lit(0).cast("bigint"), "outlier_pct": F.lit(0.0)})
    known = df.sparkSession.createDataFrame([(n, *bounds[n]) for n in names], "column string, lower double, upper double")
    return rows.join(known, "column").select("column", "lower", "upper", "outliers", "outlier_pct")


def _marks(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row by its typed values. A null has no hash of its own, so the places of nulls count as a value.

    Maps count by their entries in order of keys.
    """
    values = [F.array_sort(F.map_entries(_c(f.name))) if isinstance(f.dataType, T.MapType) else _c(f.name) for f in df.schema.fields]
    nulls = []
    for begin in range(0, len(values), 63):
        bits = [F.when(v.isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, v in enumerate(values[begin : begin + 63])]
        nulls.append(functools.reduce(Column.__add__, bits))
    return [F.xxhash64(F.lit(seed), *nulls, *values).alias(name) for seed, name in enumerate(_MARKS)]


_MARKS = ("__mark_one", "__mark_two")


def duplicates_summary(df: DataFrame) -> DataFrame:
    """One row: total, duplicates (rows beyond the first of each kind), rows_in_dup_groups.

    Rows are grouped by two 64-bit hashes, two numbers of fixed width, so a wide row is neither shuffled nor made text.
    """
    n = F.col("multiplicity")
    return df.select(*_marks(df)).groupBy(*_MARKS).agg(F.count("*").alias("multiplicity")).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_dup_groups"),
    )


def duplicated_rows(df: DataFrame, limit: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Rows that occur more than once, with their ``multiplicity``; a limited view needs an order.

    Only rows whose hashes occur more than once are compared value by value.
    """
    if limit is not None and not order_by:
        raise ValueError("a limited view of the duplicated rows needs an order")
    marked = df.select("*", *_marks(df))
    again = df.select(*_marks(df)).groupBy(*_MARKS).agg(F.count("*").alias("n")).where("n > 1").select(*_MARKS)
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    rows = marked.join(again, list(_MARKS), "left_semi").withColumns({m: F.array_sort(F.map_entries(_c(m))) for m in maps})
    rows = rows.groupBy(*[_c(n) for n in df.columns]).agg(F.count("*").alias("multiplicity")).filter("multiplicity > 1")
    rows = rows.withColumns({m: F.map_from_entries(_c(m)) for m in maps})
    return rows if limit is None else rows.orderBy(*[_c(c) for c in order_by]).limit(limit)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of a column, null included."""
    return df.groupBy(_c(column).alias("value")).agg(F.count("*").alias("count"))


def top_values(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """The k most frequent values; ties by value."""
    return value_counts(df, column).orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(k)


def top_values_of(df: DataFrame, names: Sequence[str], k: int = 15) -> DataFrame:
    """(column, value, count) of the k most frequent values of each column, as text; ties by value.

    The window sees one row a distinct value, and columns of few kinds are what it is for.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("value_count"), F.asc_nulls_last("value")))
    ranked_ = _column_values(df, names).withColumn("place", place).filter(F.col("place") <= k)
    return ranked_.select("column", "value", F.col("value_count").alias("count"))


def class_imbalance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, top_value, top_count, top_pct) of each categorical column; ties by smallest value."""
    names = list(columns) if columns is not None else categorical_columns(df, 20)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, top_value string, top_count bigint, top_pct double")
    # The smallest (-count, value) is the largest count, and the smallest value among ties.
    best = (
        _column_values(df, names)
        .groupBy("column")
        .agg(
            F.min(F.struct((-F.col("value_count")).alias("rank"), "value", "value_count")).alias("top"),
            F.sum("value_count").alias("total"),
        )
    )
    return best.select(
        "column",
        F.col("top.value").alias("top_value"),
        F.col("top.value_count").alias("top_count"),
        (F.col("top.value_count") / F.col("total")).alias("top_pct"),
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(var1, var2, corr) for every column pair, upper triangle in table order, pairwise complete.

    The correlation of a column that is constant over the shared rows, or holds an infinity, is null. Each task
    reduces its rows to counts, means and co-moments of all pairs, centred on the rows that a pair shares;
    Spark merges the tasks. One scan, the same way for any number of columns.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, corr double")
    data = df.select(*[S.valid_double(_c(n)).alias(f"x{i}") for i, n in enumerate(names)])
    k = len(names)
    rows, cols = np.triu_indices(k, 1)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            with np.errstate(invalid="ignore", over="ignore"):
                part = _moments(batch.to_numpy(dtype="float64", na_value=np.nan))
                total = part if total is None else _merged(total, part)
        if total is not None:
            yield pd.DataFrame({"i": rows, "j": cols, **{name: v[rows, cols] for name, v in total.items()}})

    schema = "i int, j int, n double, mx double, my double, cxy double, cxx double, cyy double"
    parts = data.mapInPandas(reduced, schema).where("n > 0")
    # One row a task and pair. Shifted by the smallest mean, equal means leave exactly nothing.
    pair = Window.partitionBy("i", "j")
    shifted = parts.withColumns({"dx": F.col("mx") - F.min("mx").over(pair), "dy": F.col("my") - F.min("my").over(pair)})
    n, x, y = F.col("n"), F.col("dx"), F.col("dy")

    def between(a: Column, b: Column) -> Column:
        return F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum(n)

    whole = shifted.groupBy("i", "j").agg(
        (F.sum("cxy") + between(x, y)).alias("xy"), (F.sum("cxx") + between(x, x)).alias("xx"), (F.sum("cyy") + between(y, y)).alias("yy")
    )
    ratio = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    finite = (F.col("xx") > 0) & (F.col("yy") > 0) & ~F.isnan("xx") & ~F.isnan("yy") & ~F.isnan("xy")
    corr = F.when(finite & ~F.isnan(ratio), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    pairs = df.sparkSession.createDataFrame([(int(a), int(b), names[a], names[b]) for a, b in zip(rows, cols)], "i int, j int, var1 string, var2 string")
    return pairs.join(whole.select("i", "j", corr.alias("corr")), ["i", "j"], "left").select("var1", "var2", "corr")


# A pair is centred anew on its shared rows where less than this share of the squares remains: digits have cancelled.
_CANCELLED = 1e-3


def _moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, means and co-moments of all column pairs, each over the rows that hold both.

    All of them are products of the matrix of values, zero where one is missing, and the matrix that marks the known
    ones, so gaps cost no loop over pairs. Only pairs whose shared rows lie close together, far from the
    means of their columns, are centred on these rows one by one.
    """
    known = ~np.isnan(x)
    held, count = known.astype("float64"), known.sum(axis=0)
    first = np.where(count > 0, x[known.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    # Shifted by a value of its own, a constant column is exactly zero.
    shifted = np.where(known, x - first, 0.0)
    centre = shifted.sum(axis=0) / np.maximum(count, 1)
    centred = np.where(known, shifted - centre, 0.0)
    n = held.T @ held
    sums, squares = centred.T @ held, (centred * centred).T @ held
    mean = sums / np.maximum(n, 1)
    cxy, cxx = centred.T @ centred - mean * sums.T, squares - mean * sums
    near = (n > 0) & (squares > 0) & (cxx < _CANCELLED * squares)
    for i, j in zip(*np.nonzero(near | near.T)):
        both = known[:, i] & known[:, j]
        a, b = (v - v[0] for v in (centred[both, i], centred[both, j]))
        a, b = a - a.mean(), b - b.mean()
        cxy[i, j], cxx[i, j] = a @ b, a @ a
    mean = mean + (first + centre)[:, None]
    return {"n": n, "mx": mean, "my": mean.T, "cxy": cxy, "cxx": cxx, "cyy": cxx.T.copy()}


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The moments of two sets of rows together."""
    n = a["n"] + b["n"]
    safe = np.maximum(n, 1)
    share = b["n"] / safe
    # A side without rows has no mean.
    dx = np.where((a["n"] > 0) & (b["n"] > 0), b["mx"] - a["mx"], 0.0)
    dy = np.where((a["n"] > 0) & (b["n"] > 0), b["my"] - a["my"], 0.0)
    weight = a["n"] * share
    mean = lambda key, d: np.where(a["n"] > 0, a[key] + d * share, b[key])
    return {
        "n": n, "mx": mean("mx", dx), "my": mean("my", dy), "cxy": a["cxy"] + b["cxy"] + dx * dy * weight,
        "cxx": a["cxx"] + b["cxx"] + dx * dx * weight, "cyy": a["cyy"] + b["cyy"] + dy * dy * weight,
    }


def high_correlation_pairs(corr: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs whose correlation is at least the threshold in absolute value."""
    return corr.filter(F.abs("corr") >= threshold)


def variance_ranking(df: DataFrame, columns: Sequence[str] | None = None, k: int | None = None) -> DataFrame:
    """The columns by falling sample variance, all or the first k; those with fewer than two values are left out."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, variance double")
    rows = _grouped_statistics(df, names).select("column", "variance").filter(F.col("variance").isNotNull())
    ordered = rows.orderBy(F.desc("variance"), "column")
    return ordered if k is None else ordered.limit(k)


def histograms(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]], bins: int = 50) -> DataFrame:
    """(column, bin, low, high, count) of equal-width bins between the given ends of each column.

    The last bin is closed, empty bins are included, columns without values left out. All columns share one scan.
    """
    spark = df.sparkSession
    known = {}
    for name, (low, high) in ranges.items():
        if low is not None and high is not None and math.isfinite(low) and math.isfinite(high):
            known[name] = (low - 0.5, high + 0.5) if low == high else (low, high)
    edges = [
        (name, k, low + k * ((high - low) / bins), low + (k + 1) * ((high - low) / bins))
        for name, (low, high) in known.items()
        for k in range(bins)
    ]
    titles = spark.createDataFrame(edges, "column string, bin int, low double, high double")
    if not known:
        return titles.withColumn("count", F.lit(0).cast("bigint"))
    places = {
        name: F.when(value.isNotNull(), F.least(F.floor((value - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1)))
        for (name, (low, high)), value in zip(known.items(), _numbers(list(known)).values())
    }
    counted = _cells(df, places).filter("value is not null").groupBy("column", F.col("value").alias("bin")).agg(F.count("*").alias("count"))
    # One row a column and bin on both sides.
    joined = titles.join(counted, ["column", "bin"], "left")
    return joined.select("column", "bin", "low", "high", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, count) of equal-width bins from min to max, the last one closed, empty bins included."""
    value = S.valid_double(_c(column))
    low, high = df.agg(F.min(value), F.max(value)).first()
    return histograms(df, {column: (low, high)}, bins).drop("column")


def explore_statistics(df: DataFrame, first: int | None = None) -> DataFrame:
    """Mean, deviation, min, max and null count of the numeric columns, all or the first ones."""
    names = numeric_columns(df)[:first]
    schema = "column string, mean double, std double, min double, max double, null_count bigint"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    rows = _grouped_statistics(df, names).withColumn("null_count", F.col("rows") - F.col("count"))
    rows = _for_columns(df, names, rows, {"null_count": F.lit(0).cast("bigint")})
    return rows.select("column", "mean", "std", "min", "max", "null_count")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, min, quartiles and max of numeric columns, one row per column."""
    rows = numeric_distributions(df, columns)
    return rows.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def ranked(profile: DataFrame, by: str, k: int = 20) -> DataFrame:
    """The k profile rows with the largest value, ties by column name."""
    return profile.orderBy(F.desc_nulls_last(by), "column").limit(k)
