"""Registered profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, quantiles, relational
from ..sources import catalog
from . import jobs
from .registered import query, rounded, table

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with gaps: no value on errors, no user on clicks of low value."""
    quiet = (F.col("event_type") == "click") & (F.col("value") < 10)
    return table(spark, folder, "events").withColumns(
        {
            "user_id": F.when(~quiet, F.col("user_id")),
            "value": F.when(F.col("event_type") != "error", F.col("value")),
        }
    )


_EVENTS = """events_gaps as (
  select event_id, ts, case when event_type = 'click' and value < 10 then null else user_id end as user_id,
    event_type, case when event_type <> 'error' then value end as value, props
  from events)"""

_EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
    "event_type": "string", "value": "double", "props": "string",
}


def _union(parts) -> str:
    return "\nunion all\n".join(parts)


@query(
    "schema_missing",
    f"with {_EVENTS}\n"
    + _union(
        f"""select '{c}' as "column", '{t}' as dtype, count(*) - count({c}) as null_count,
        round((count(*) - count({c})) / count(*), 6) as null_pct from events_gaps"""
        for c, t in _EVENT_TYPES.items()
    ),
)
def schema_missing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.schema_and_missing(_events(spark, folder)))


_QUANTILES = {"q00": 0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q100": 1}


def _distribution_sql(source: str, column: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont({column}, {q}), 6) as {n}" for n, q in _QUANTILES.items())
    return f"""select '{column}' as "column", count({column}) as "count", round(avg({column}), 6) as mean,
      round(stddev_samp({column}), 6) as std, round(min({column}), 6) as "min", round(max({column}), 6) as "max",
      {quantiles} from {source}"""


@query("numeric_distributions", _union(_distribution_sql("lineitem", c) for c in MEASURES))
def numeric_distributions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.numeric_distributions(table(spark, folder, "lineitem"), MEASURES))


_WITH_NAN = "case when l_returnflag = 'R' then {nan} else {column} end as {column}"


def _with_nan(nan: str) -> str:
    return ", ".join(_WITH_NAN.format(nan=nan, column=c) for c in MEASURES)


@query(
    "profile_nan",
    f"with gaps as (select {_with_nan('null')} from lineitem)\n" + _union(
        f"""select s.*, o.lower, o.upper, o.outliers, o.outlier_pct, m.null_count from ({_distribution_sql("gaps", c)}) s,
        (select round(lo, 6) as lower, round(hi, 6) as upper, count(*) filter ({c} < lo or {c} > hi) as outliers,
          round(count(*) filter ({c} < lo or {c} > hi) / count(*), 6) as outlier_pct
        from gaps, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
          (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from gaps)) group by lo, hi) o,
        (select count(*) - count({c}) as null_count from gaps) m"""
        for c in MEASURES
    ),
)
def profile_nan(spark: SparkSession, folder: str) -> DataFrame:
    """NaN counts as missing in every part of the profile."""
    rows = table(spark, folder, "lineitem").selectExpr(*[_WITH_NAN.format(nan="double('NaN')", column=c) for c in MEASURES])
    missing = profile.schema_and_missing(rows).select("column", "null_count")
    return rounded(profile.numeric_distributions(rows).join(profile.outliers_iqr(rows), "column").join(missing, "column"))


@query(
    "profile_job",
    """select * from (values ('schema_missing', 3), ('outliers_iqr', 2), ('correlations', 1), ('histograms', 100)) t("table", "rows")
    union all select 'top_values', least(count(distinct c_mktsegment), 15) from customer
    union all select 'duplicates_sample', 0 from (select count(*) from customer)""",
)
def profile_job(spark: SparkSession, folder: str) -> DataFrame:
    """The sizes of the tables of a profile job over the customers."""
    tables = jobs.profile_tables(table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))
    names = ("schema_missing", "outliers_iqr", "correlations", "histograms", "top_values", "duplicates_sample")
    return catalog.concat_by_name([tables[n].agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in names])


@query(
    "explore_job",
    """select 'O' as value, count(*) filter (o_orderstatus = 'O') as "count", 100 as sampled from orders
    union all select 'F', count(*) filter (o_orderstatus = 'F'), 100 from orders
    union all select 'P', count(*) filter (o_orderstatus = 'P'), 100 from orders""",
)
def explore_job(spark: SparkSession, folder: str) -> DataFrame:
    """Label distribution and size of the sample of an explored catalogue."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("kepoi_name"), F.col("o_orderstatus").alias("koi_disposition"), "o_totalprice"
    )
    found = jobs.explore(orders, ["o_totalprice", "kepoi_name"])
    sampled = found["sample"].agg(F.count("*").cast("int")).scalar()
    return found["distribution"].select("value", "count", sampled.alias("sampled"))


@query(
    "curve_statistics",
    f"""with {_EVENTS}
    select 'value' as "column", count(value) as "count", round(avg(value), 6) as mean,
      round(stddev_samp(value), 6) as std, round(min(value), 6) as "min", round(quantile_cont(value, 0.25), 6) as q25,
      round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75,
      round(max(value), 6) as "max"
    from events_gaps""",
)
def curve_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.describe(_events(spark, folder), ["value"]))


_OUTLIER_SOURCES = {"c_acctbal": "customer", "o_totalprice": "orders", "p_retailprice": "part", "value": "events"}


def _outlier_sql(source: str, column: str) -> str:
    return f"""select '{column}' as "column", round(lo, 6) as lower, round(hi, 6) as upper,
      count(*) filter ({column} < lo or {column} > hi) as outliers,
      round(count(*) filter ({column} < lo or {column} > hi) / count(*), 6) as outlier_pct
    from {source}, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
      (select quantile_cont({column}, 0.25) as q1, quantile_cont({column}, 0.75) as q3 from {source}))
    group by lo, hi"""


@query("iqr_outliers", _union(_outlier_sql(t, c) for c, t in _OUTLIER_SOURCES.items()))
def iqr_outliers(spark: SparkSession, folder: str) -> DataFrame:
    parts = [profile.outliers_iqr(table(spark, folder, t), [c]) for c, t in _OUTLIER_SOURCES.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result)


@query(
    "profile_ranked",
    f"""select * from ({_union(_outlier_sql("lineitem", c) for c in MEASURES)})
    order by outlier_pct desc, "column" limit 20""",
)
def profile_ranked(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.outliers_iqr(table(spark, folder, "lineitem"), MEASURES)
    return rounded(profile.ranked(rows, "outlier_pct", 20))


@query(
    "duplicates_summary",
    """select cast(sum(l_linenumber) as bigint) as total, cast(sum(l_linenumber - 1) as bigint) as duplicates,
      cast(coalesce(sum(l_linenumber) filter (l_linenumber > 1), 0) as bigint) as rows_in_dup_groups
    from lineitem""",
)
def duplicates_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Whole rows: every order line as often as its number says."""
    rows = table(spark, folder, "lineitem")
    return profile.duplicates_summary(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "l_linenumber"))).drop("copy"))


@query(
    "duplicates_sample",
    "select text, count(*) as multiplicity from documents group by text having count(*) > 1",
)
def duplicates_sample(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicated_rows(table(spark, folder, "documents").select("text"))


def _imbalance_sql(source: str, column: str) -> str:
    return f"""select '{column}' as "column", value as top_value, n as top_count, round(n / total, 6) as top_pct
    from (select {column} as value, count(*) as n, sum(count(*)) over () as total,
        row_number() over (order by count(*) desc, {column}) as place
      from {source} group by {column}) where place = 1"""


@query(
    "class_imbalance",
    _union(
        _imbalance_sql(t, c)
        for c, t in {"o_orderstatus": "orders", "o_orderpriority": "orders", "c_mktsegment": "customer"}.items()
    ),
)
def class_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    orders = profile.class_imbalance(table(spark, folder, "orders"))
    customers = profile.class_imbalance(table(spark, folder, "customer"), ["c_mktsegment"])
    return rounded(orders.unionByName(customers))


@query(
    "categorical_columns",
    """select name as "column" from (
      select 'p_name' as name, count(distinct p_name) + max(case when p_name is null then 1 else 0 end) as n from part
      union all select 'p_brand', count(distinct p_brand) + max(case when p_brand is null then 1 else 0 end) from part
      union all select 'p_type', count(distinct p_type) + max(case when p_type is null then 1 else 0 end) from part)
    where n <= 20""",
)
def categorical_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = profile.categorical_columns(table(spark, folder, "part"), 20)
    return spark.createDataFrame([(n,) for n in names], "column string")


@query("value_counts", f'with {_EVENTS} select user_id as value, count(*) as "count" from events_gaps group by user_id')
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(_events(spark, folder), "user_id")


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _corr_sql(source: str, names) -> str:
    return _union(
        f"select '{a}' as var1, '{b}' as var2, round(corr({a}, {b}), 6) as corr from {source}" for a, b in _pairs(names)
    )


@query("correlation_pairs", _corr_sql("lineitem", MEASURES))
def correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlations(table(spark, folder, "lineitem"), MEASURES))


@query(
    "correlation_with_gaps",
    f"with {_EVENTS}\n"
    + _corr_sql("events_gaps", ("event_id", "user_id", "value"))
    + """
union all
select a as var1, 'same' as var2, null as corr
from (values ('event_id'), ('user_id'), ('value')) t(a)""",
)
def correlation_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("same", F.lit(1.5))
    return rounded(profile.correlations(rows, ["event_id", "user_id", "value", "same"]))


_WIDE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net")
_OPEN_TAX = "case when l_linestatus = 'O' then l_tax end"


@query(
    "correlation_wide",
    f"""with w as (select * replace ({_OPEN_TAX} as l_tax), l_extendedprice * (1 - l_discount) as net from lineitem)
    {_corr_sql("w", _WIDE)}""",
)
def correlation_wide(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumns(
        {"l_tax": F.expr(_OPEN_TAX), "net": F.expr("l_extendedprice * (1 - l_discount)")}
    )
    return rounded(profile.correlations(rows, _WIDE))


@query(
    "quantile_scans",
    _union(
        f"""select '{c}' as "column", {q}::double as fraction, round(quantile_cont({c}, {q}), 6) as value from lineitem"""
        for c in ("l_extendedprice", "l_discount")
        for q in (0.1, 0.5, 0.99)
    ),
)
def quantile_scans(spark: SparkSession, folder: str) -> DataFrame:
    names, fractions = ["l_extendedprice", "l_discount"], [0.1, 0.5, 0.99]
    found = quantiles.exact_quantiles(table(spark, folder, "lineitem"), names, fractions)
    rows = [(c, q, v) for c in names for q, v in zip(fractions, found[c])]
    return rounded(spark.createDataFrame(rows, "column string, fraction double, value double"))


_NET = "(select *, l_extendedprice * (1 - l_discount) as net_price from lineitem)"


@query("high_correlation", f"select * from ({_corr_sql(_NET, (*MEASURES, 'net_price'))}) where abs(corr) >= 0.9")
def high_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("net_price", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(profile.high_correlation_pairs(profile.correlations(rows, [*MEASURES, "net_price"])))


@query(
    "variance_topk",
    "select * from ("
    + _union(f"""select '{c}' as "column", round(var_samp({c}), 2) as variance from lineitem""" for c in MEASURES)
    + """) order by variance desc, "column" limit 3""",
)
def variance_topk(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.variance_ranking(table(spark, folder, "lineitem"), MEASURES, 3), 2)


@query(
    "histogram",
    """with bounds as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
    placed as (
      select least(cast(floor((o_totalprice - lo) / ((hi - lo) / 50)) as int), 49) as bin from orders, bounds)
    select cast(b as int) as bin, round(lo + b * ((hi - lo) / 50), 6) as low,
      round(lo + (b + 1) * ((hi - lo) / 50), 6) as high, count(placed.bin) as "count"
    from range(50) r(b), bounds left join placed on placed.bin = r.b
    group by b, lo, hi""",
)
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.histogram(table(spark, folder, "orders"), "o_totalprice", 50))


@query(
    "explore_stats",
    _union(
        f"""select '{c}' as "column", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
        round(min({c}), 6) as "min", round(max({c}), 6) as "max", count(*) - count({c}) as null_count from customer"""
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ),
)
def explore_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.explore_statistics(table(spark, folder, "customer")))


@query(
    "topk_categories",
    'select p_brand as value, count(*) as "count" from part group by p_brand order by count(*) desc, p_brand limit 15',
)
def topk_categories(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(table(spark, folder, "part"), "p_brand", 15)


@query(
    "explore_sample",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 100",
)
def explore_sample(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.head(orders, 100, ["o_totalprice", "o_orderkey"])


@query(
    "concat_batches",
    """select o_custkey as tic, o_totalprice as flux, null as note from orders
    union all select c_custkey, c_acctbal, c_mktsegment from customer
    union all select s_suppkey, null, s_name from supplier""",
)
def concat_batches(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.concat_by_name(
        [
            table(spark, folder, "orders").selectExpr("o_custkey as tic", "o_totalprice as flux"),
            table(spark, folder, "customer").selectExpr("c_mktsegment as note", "c_acctbal as flux", "c_custkey as tic"),
            table(spark, folder, "supplier").selectExpr("s_name as note", "s_suppkey as tic"),
        ]
    )
