"""Registered queries on catalogue text, formats, checks, splits, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formats, learning, metrics, relational, split
from ..sources import catalog
from ..session import stage
from . import jobs
from .registered import query, rounded, table

_HEADER = "key,name,balance,segment"


def _lines(spark: SparkSession, folder: str, line: str) -> DataFrame:
    """Catalogue text of the customers: a header, a comment before and an indented one after every row."""
    rows = table(spark, folder, "customer").select(
        F.explode(
            F.array(F.concat(F.lit("# nation "), F.col("c_nationkey").cast("string")), F.expr(line), F.lit("   # end"))
        ).alias("value")
    )
    header = table(spark, folder, "region").agg(F.lit(_HEADER).alias("value"))
    return header.unionAll(rows)


_ROW = "concat_ws(',', c_custkey, c_name, {balance}, c_mktsegment)"


@query(
    "catalog_text",
    "select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer",
)
def catalog_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder, _ROW.format(balance="c_acctbal"))
    return catalog.catalog_from_lines(lines, required=["key", "name"])


@query(
    "catalog_tolerant",
    """select c_custkey as key, c_name as name, case when c_mktsegment <> 'MACHINERY' then c_acctbal end as balance,
      c_mktsegment as segment from customer""",
)
def catalog_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    balance = "if(c_mktsegment = 'MACHINERY', 'n/a', cast(c_acctbal as string))"
    types = {"key": "bigint", "balance": "double"}
    return catalog.catalog_from_lines(_lines(spark, folder, _ROW.format(balance=balance)), types=types)


@query(
    "catalog_long_lines",
    """select c_custkey as key, c_name as name, case when c_mktsegment <> 'FURNITURE' then c_acctbal end as balance,
      case when c_mktsegment <> 'FURNITURE' then c_mktsegment end as segment
    from customer where c_mktsegment <> 'MACHINERY'""",
)
def catalog_long_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = f"""case c_mktsegment when 'MACHINERY' then concat({_ROW.format(balance="c_acctbal")}, ',')
      when 'FURNITURE' then concat_ws(',', c_custkey, c_name) else {_ROW.format(balance="c_acctbal")} end"""
    types = {"key": "bigint", "balance": "double"}
    return catalog.catalog_from_lines(_lines(spark, folder, line), types=types, drop_long_lines=True)


_BATCHES = (("id", "price", "status"), ("status", "id", "urgency"), ("price", "id"), ("id", "status", "price", "urgency"), ("urgency", "price", "id"))


@query(
    "batch_merge",
    """with rows_ as (select *, o_custkey % 5 as k from orders)
    select o_orderkey as id, case when k <> 1 then o_totalprice end as price, case when k in (0, 1, 3) then o_orderstatus end as status,
      case when k in (1, 3, 4) then o_orderpriority end as urgency, 'batch_' || k as batch from rows_""",
)
def batch_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of text under five different headers, merged by the names of their columns."""
    given = {"id": "o_orderkey", "price": "o_totalprice", "status": "o_orderstatus", "urgency": "o_orderpriority"}
    k, value, header = F.col("o_custkey") % 5, F.lit(None), F.lit(None)
    for i, names in enumerate(_BATCHES):
        value = F.when(k == i, F.concat_ws(",", *[given[n] for n in names])).otherwise(value)
        header = F.when(F.col("id") == i, F.lit(",".join(names))).otherwise(header)
    rows = table(spark, folder, "orders").select(value.alias("value"), F.concat(F.lit("batch_"), k).alias("file"), F.col("o_orderkey").alias("place"))
    heads = spark.range(len(_BATCHES)).select(header.alias("value"), F.concat(F.lit("batch_"), "id").alias("file"), F.lit(-1).cast("bigint").alias("place"))
    cells = catalog.parse_files(heads.union(rows), carry=["file"])
    typed = catalog.cast_cells(cells, {"id": "bigint", "price": "double"})
    return typed.select("id", "price", "status", "urgency", F.col("file").alias("batch"))


@query(
    "row_shape",
    r"""select count(*) as "rows", count(*) filter (len(string_split(text, ',')) <> 3) as wrong_rows,
      count(*) >= 1 and count(*) filter (len(string_split(text, ',')) <> 3) <= count(*) * 0.1 as is_valid
    from documents where regexp_matches(text, '\S') and not regexp_matches(text, '^\s*#')""",
)
def row_shape(spark: SparkSession, folder: str) -> DataFrame:
    return formats.row_shape(table(spark, folder, "documents").select(F.col("text").alias("value")), 3)


# Columns of the orders under the names of each format; the first label column of the first is empty.
_AS_FORMAT = {
    "kepler": {"o_orderkey": "kepoi_name", "o_clerk": "koi_pdisposition", "o_orderstatus": "koi_disposition"},
    "tess": {"o_orderkey": "toi", "o_orderstatus": "tfopwg_disp"},
    "k2": {"o_custkey": "pl_name", "o_totalprice": "pl_orbper", "o_orderpriority": "disposition"},
    "none": {"o_custkey": "pl_name"},
}


@query(
    "format_detect",
    """select 'kepler' as given, 'kepler' as format, 'koi_disposition' as label, count(o_orderstatus) as labelled from orders
    union all select 'tess', 'tess', 'tfopwg_disp', count(o_orderstatus) from orders
    union all select 'k2', 'k2', 'disposition', count(o_orderpriority) from orders
    union all select 'none', null, null, 0""",
)
def format_detect(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("o_clerk", F.lit(None).cast("string"))
    parts = []
    for given, names in _AS_FORMAT.items():
        df = orders.withColumnsRenamed(names)
        name = formats.detect_format(df.columns)
        label = formats.label_column(df, name)
        labelled = F.count(F.col(label)) if label else F.lit(0).cast("bigint")
        parts.append(
            df.agg(labelled.alias("labelled")).select(
                F.lit(given).alias("given"), F.lit(name).cast("string").alias("format"),
                F.lit(label).cast("string").alias("label"), "labelled",
            )
        )
    return catalog.concat_by_name(parts)


@query(
    "format_strict",
    """select 'kepler' as given, 'kepler_koi' as format, 'koi_period' as missing, (select count(*) > 0 from orders) as filled
    union all select 'tess', 'tess_toi', 'pl_orbper', (select count(*) > 0 from orders)
    union all select 'k2', 'k2', '', (select count(*) > 0 from orders)
    union all select 'none', null, '', (select count(*) > 0 from orders)""",
)
def format_strict(spark: SparkSession, folder: str) -> DataFrame:
    """The strict check of each format's columns, and whether the table has rows at all."""
    orders = table(spark, folder, "orders")
    filled, parts = not formats.is_empty(orders), []
    for given, names in _AS_FORMAT.items():
        name, missing = formats.detect_strict(orders.withColumnsRenamed(names).columns)
        parts.append((given, name, ",".join(missing), filled))
    return spark.createDataFrame(parts, "given string, format string, missing string, filled boolean")


@query(
    "training_check",
    """with rows_ as (select case when l_returnflag = 'A' then 'CONFIRMED' when l_returnflag = 'N' then l_returnflag end as label
      from lineitem)
    select false as usable, (select count(*) from lineitem) as "rows", 3 as "columns", coalesce(label, 'null') as class, count(*) as n,
      3 as findings from rows_ group by label""",
)
def training_check(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict, sizes and class distribution of a table with a bad and a missing label."""
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_quantity as orbital_period",
        "case when l_linestatus <> 'F' then l_tax else double('NaN') end as transit_duration",
        "case when l_returnflag = 'A' then 'CONFIRMED' when l_returnflag = 'N' then l_returnflag end as disposition",
    )
    found = formats.training_check(rows)
    size = (F.size("errors") + F.size("warnings")).alias("findings")
    return found.select("usable", "rows", "columns", size, F.explode("class_distribution").alias("class", "n"))


@query(
    "label_trim",
    """select l_returnflag as label, case when l_tax > 0.05 then 'N' else l_returnflag end as prediction, count(*) as n
    from lineitem group by 1, 2""",
)
def label_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Labels are compared without the blanks around them."""
    scored = table(spark, folder, "lineitem").selectExpr(
        "concat('  ', l_returnflag, ' ') as original_label",
        "case when l_tax > 0.05 then 'N' else l_returnflag end as predicted_label",
    )
    return learning.evaluate(scored)


@query(
    "feature_columns",
    """select unnest(['koi_insol', 'koi_period', 'koi_depth', 'koi_prad', 'koi_duration', 'koi_count']) as feature
    from (select count(*) from lineitem)""",
)
def feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric columns with values, without the label, the name and an empty column."""
    df = order_catalog(spark, folder).withColumn("empty", F.lit(float("nan")))
    names = learning.feature_columns(df, "koi_pdisposition", "kepoi_name")
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _kepler_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("kepoi_name"),
        F.col("o_orderstatus").alias("koi_pdisposition"),
        F.col("o_totalprice").alias("koi_period"),
        "o_custkey",
    )


@query(
    "catalog_report",
    """select true as is_valid, 'kepler' as format, 'Kepler Objects of Interest (KOI)' as format_name,
      'koi_pdisposition' as label_column, true as has_labels, (select count(*) from orders) as total_rows,
      4 as total_columns, 'koi_period,o_custkey' as numeric_columns, o_orderstatus as label, count(*) as n
    from orders group by o_orderstatus""",
)
def catalog_report(spark: SparkSession, folder: str) -> DataFrame:
    report = formats.catalog_report(_kepler_orders(spark, folder))
    return report.select(
        "is_valid", "format", "format_name", "label_column", "has_labels", "total_rows", "total_columns",
        F.array_join("numeric_columns", ",").alias("numeric_columns"),
        F.explode("label_distribution").alias("label", "n"),
    )


@query(
    "label_check",
    """select o_orderstatus as value, count(*) as "count" from orders
    where o_orderstatus not in ('F', 'O') group by o_orderstatus""",
)
def label_check(spark: SparkSession, folder: str) -> DataFrame:
    return formats.unexpected_labels(table(spark, folder, "orders"), "o_orderstatus", ["F", "O"])


@query(
    "standard_checks",
    """select 'error' as severity, 'missing_columns' as "check", 'transit_depth, planet_radius' as detail
    union all select 'warning', 'null_values', 'transit_duration: ' || count(*) from lineitem where l_linestatus = 'F'
    union all select 'error', 'invalid_label', l_returnflag || ': ' || count(*) from lineitem
      where l_returnflag <> 'A' group by l_returnflag""",
)
def standard_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_quantity as orbital_period",
        "case when l_linestatus <> 'F' then l_tax end as transit_duration",
        "case when l_returnflag = 'A' then 'CONFIRMED' else l_returnflag end as disposition",
    )
    return formats.standard_checks(rows, for_training=True)


@query(
    "impute_mean",
    """with gaps as (select event_id, case when event_type <> 'error' then value end as value,
      case when event_type = 'click' then user_id end as user_id from events)
    select event_id, round(coalesce(value, avg(value) over ()), 6) as value,
      round(coalesce(user_id, avg(user_id) over ()), 6) as user_id, 0.0::double as empty from gaps""",
)
def impute_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").selectExpr(
        "event_id",
        "case when event_type <> 'error' then value end as value",
        "case when event_type = 'click' then user_id end as user_id",
        "cast(null as double) as empty",
    )
    means = learning.column_means(rows, ["value", "user_id", "empty"])
    return rounded(learning.fill_with_means(rows, means))


def _draw_sql(seed: int, key: str) -> str:
    return f"cast('0x' || substr(md5('{seed}|' || {key}), 1, 13) as bigint)"


@query(
    "exact_sample",
    f"""select o_orderkey, o_custkey, o_totalprice from orders
    order by {_draw_sql(79, "o_orderkey")}, o_orderkey limit 50""",
)
def exact_sample(spark: SparkSession, folder: str) -> DataFrame:
    return relational.exact_sample(table(spark, folder, "orders"), 50, ["o_orderkey"], 79).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "stratified_split",
    f"""with classes as (select o_orderpriority as label, count(*) as n, sum(count(*)) over () as total
      from orders group by o_orderpriority),
    shares as (select label, n, total, total - cast(ceil(total * 0.3) as bigint) as n_train from classes),
    placed as (select *, cast(n * n_train // total as bigint) as base,
      row_number() over (order by (n * n_train) % total desc, label) as place from shares),
    sizes as (select label, base + case when place <= n_train - sum(base) over () then 1 else 0 end as k from placed),
    ranked as (select o_orderkey, o_orderpriority as label,
      row_number() over (partition by o_orderpriority order by {_draw_sql(42, "o_orderkey")}) as place from orders)
    select r.label, case when place <= k then 'train' else 'test' end as part, count(*) as n,
      cast(sum(o_orderkey) as bigint) as key_sum
    from ranked r join sizes s on s.label = r.label group by all""",
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    parts = split.stratified_split(table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey"], 0.3, 42)
    return parts.groupBy(F.col("o_orderpriority").alias("label"), "part").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


# --- metrics: the return flag is the truth, some lines are predicted wrongly ----------------------

_FOUND = "case when l_discount >= 0.08 then 'A' when l_tax >= 0.07 then 'N' else l_returnflag end"
_OUTCOMES = f"outcomes as (select l_returnflag as label, {_FOUND} as prediction from lineitem)"


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("label"), F.expr(_FOUND).alias("prediction"))
    return metrics.outcome_counts(rows)


@query(
    "confusion",
    f"""with {_OUTCOMES} select label, count(*) filter (prediction = 'A') as "predicted_A",
      count(*) filter (prediction = 'N') as "predicted_N", count(*) filter (prediction = 'R') as "predicted_R",
      count(*) filter (prediction = 'none') as predicted_none from outcomes group by label
    union all select 'none', 0, 0, 0, 0""",
)
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(_outcomes(spark, folder), ["A", "N", "R", "none"])


@query(
    "class_report",
    f"""with {_OUTCOMES},
    per_class as (select c as class, count(*) filter (label = c and prediction = c) as tp,
        count(*) filter (label = c) as support, count(*) filter (prediction = c) as found
      from outcomes, (select distinct label as c from outcomes) group by c),
    scored as (select class, coalesce(tp / nullif(found, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
        coalesce(2 * tp / nullif(support + found, 0), 0) as f1, support from per_class),
    report as (select * from scored
      union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from scored
      union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), cast(sum(support) as bigint) from scored
      union all select 'accuracy', null, null, avg(case when label = prediction then 1.0 else 0.0 end), count(*) from outcomes)
    select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from report""",
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.classification_report(_outcomes(spark, folder)))


# --- models: an order is an object, its lines give the features, and its label follows from them --------

# The classifiers of the queries are fitted on at most so many labelled rows, which fill one partition; all rows
# are split and scored.
FIT = {"max_labelled": 4_000, "partitions": 1}
_TWO = "case when coalesce(koi_period, 0) >= 100 then 'F' else 'O' end"
_THREE = "case when coalesce(koi_period, 0) >= 130 then 'HIGH' when koi_period >= 70 then 'MID' else 'LOW' end"


def order_catalog(spark: SparkSession, folder: str, label: str = _TWO) -> DataFrame:
    """Orders as a catalogue of objects with a label and numeric columns."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("koi_period"),
        F.avg("l_extendedprice").alias("koi_depth"),
        F.max("l_discount").alias("koi_prad"),
        F.min("l_tax").alias("koi_duration"),
        F.count("*").alias("koi_count"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("koi_insol"))
    joined = orders.join(lines, "o_orderkey", "left").withColumn("koi_pdisposition", F.expr(label))
    return joined.select(F.col("o_orderkey").cast("string").alias("kepoi_name"), *joined.columns[1:])


_OBJECTS = """objects as (select o_orderkey, {label} as label from orders
  left join (select l_orderkey, sum(l_quantity) as koi_period from lineitem group by l_orderkey) on l_orderkey = o_orderkey)"""


def vetted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job on the orders: report, train, score and vet."""
    vetted = _vetting_job(spark, folder)["vetted"]
    return vetted.select(
        "name", "original_status", "predicted_status", "confidence",
        "characteristics.period", "characteristics.radius", "confirmable",
    )


def _vetting_job(spark: SparkSession, folder: str) -> dict[str, object]:
    catalogue = stage(order_catalog(spark, folder), "orders")
    return jobs.analyze_catalog(catalogue, confirmable=["F"], **FIT)


@query(
    "catalog_vet_flagship",
    f"""with {_OBJECTS.format(label=_TWO)}, whole as (select count(*) as total, cast(ceil(count(*) * 0.3) as bigint) as n_test from objects)
    select label as original_status, count(*) as objects, any_value(total - n_test) as n_train, any_value(n_test) as n_test,
      true as vetted_right, true as accurate, true as scores_stored, true as record_scored from objects, whole group by label""",
)
def catalog_vet_flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job, with checks that a model which learned nothing fails."""
    found = _vetting_job(spark, folder)
    model, vetted = found["model"], found["vetted"]
    record = learning.score_record(model, spark, {"kepoi_name": "x", "koi_period": 190.0}).first()
    right = F.avg((F.col("confirmable") == (F.col("original_status") == "F")).cast("int")) >= 0.9
    stored = model.scores["accuracy"] >= 0.95 and model.training_seconds > 0 and len(model.scores["confusion"]) == 2
    return vetted.groupBy("original_status").agg(F.count("*").alias("objects"), right.alias("vetted_right")).select(
        "original_status", "objects", F.lit(model.n_train).cast("bigint").alias("n_train"),
        F.lit(model.n_test).cast("bigint").alias("n_test"), "vetted_right", F.lit(model.scores["accuracy"] >= 0.95).alias("accurate"),
        F.lit(bool(stored)).alias("scores_stored"), F.lit(record["predicted_label"] == "F").alias("record_scored"),
    )


def _train_sql(label: str) -> str:
    return f"""with {_OBJECTS.format(label=label)}, whole as (select cast(ceil(count(*) * 0.2) as bigint) as n_test, count(*) as total from objects)
    select label as original_label, count(*) as objects, count(*) as labels_known, count(*) as scores_add_up,
      count(*) as confidence_is_largest, any_value(total - n_test) as n_train, any_value(n_test) as n_test,
      true as accurate, count(*) as counted from objects, whole group by label"""


def _train_and_score(spark: SparkSession, folder: str, label: str, algorithm: str | None, least: float) -> DataFrame:
    """Every object is scored with a known label and a distribution over all labels, and most of them right."""
    df = stage(order_catalog(spark, folder, label), "orders")
    model, test = learning.train(
        df, "koi_pdisposition", "kepoi_name", "kepler", algorithm, keys=["kepoi_name"], **FIT
    )
    accuracy = metrics.accuracy(learning.evaluate(test)).first()["accuracy"]
    scored = stage(jobs.predict_dataset(model, df)["predictions"], "scored")
    counts = scored.groupBy("original_label").agg(F.count("*").alias("counted"))
    shares = F.map_values("probabilities")
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    checked = scored.groupBy("original_label").agg(
        F.count("*").alias("objects"),
        F.count_if(F.col("predicted_label").isin(*model.labels)).alias("labels_known"),
        F.count_if((F.abs(total - 1) < 1e-9) & (F.size(shares) == len(model.labels))).alias("scores_add_up"),
        F.count_if(F.col("confidence") == F.try_element_at("probabilities", F.col("predicted_label"))).alias(
            "confidence_is_largest"
        ),
    )
    return checked.join(counts, "original_label").select(
        *checked.columns, F.lit(model.n_train).cast("bigint").alias("n_train"), F.lit(model.n_test).cast("bigint").alias("n_test"),
        F.lit(accuracy >= least).alias("accurate"), "counted",
    )


@query("train_predict", _train_sql(_THREE))
def train_predict(spark: SparkSession, folder: str) -> DataFrame:
    """A forest on three classes."""
    return _train_and_score(spark, folder, _THREE, "random_forest", 0.95)


@query("train_boosted", _train_sql(_TWO))
def train_boosted(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on two classes, the default."""
    return _train_and_score(spark, folder, _TWO, None, 0.95)


@query("train_boosted_many", _train_sql(_THREE))
def train_boosted_many(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on three classes, one against the rest."""
    return _train_and_score(spark, folder, _THREE, "gradient_boosting", 0.95)


@query("train_network", _train_sql(_TWO))
def train_network(spark: SparkSession, folder: str) -> DataFrame:
    return _train_and_score(spark, folder, _TWO, "neural_network", 0.9)


@query("train_svm", _train_sql(_TWO))
def train_svm(spark: SparkSession, folder: str) -> DataFrame:
    return _train_and_score(spark, folder, _TWO, "svm", 0.9)


@query(
    "importances",
    """select 'koi_period' as feature, true as sums_to_one, 6 as features, (select count(*) > 0 from lineitem) as learned""",
)
def importances(spark: SparkSession, folder: str) -> DataFrame:
    """The most important feature of a model is the one that its label follows from."""
    df = stage(order_catalog(spark, folder), "orders")
    model, _ = learning.train(
        df, "koi_pdisposition", "kepoi_name", algorithm="random_forest", keys=["kepoi_name"], **FIT
    )
    top = learning.importance_table(spark, model, 1).select("feature")
    weights = [w for _, w in model.importances]
    ordered = abs(sum(weights) - 1) < 1e-9 and weights == sorted(weights, reverse=True)
    return top.select("feature", F.lit(ordered).alias("sums_to_one"), F.lit(len(weights)).alias("features"), F.lit(True).alias("learned"))
