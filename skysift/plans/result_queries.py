"""Registered queries on dispositions, score results, vetting and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as S
from ..operators import formats, results, vetting
from ..sources import catalog, sinks
from . import jobs
from .registered import query, rounded, table


_OFFICIAL_ID = "case when o_orderpriority = '5-LOW' then -o_orderkey else o_orderkey end"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of targets: every order line is one event of its order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("target_id"), (F.col("l_discount") * 10).alias("score")
    )


def _official(spark: SparkSession, folder: str) -> DataFrame:
    """Dispositions of all orders; those of low priority under ids that no score has."""
    return table(spark, folder, "orders").select(F.expr(_OFFICIAL_ID).alias("tic"), F.col("o_orderstatus").alias("disposition"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return results.results_table(_scores(spark, folder), _official(spark, folder))


_RESULTS = f"""best as (select l_orderkey as tic_id, max(l_discount * 10) as score from lineitem group by l_orderkey),
results as (
  select tic_id, case when score <= 0.5 then 'False positive' when score <= 0.9 then 'Planetary candidate'
      else 'Confirmed planet' end as result, score,
    coalesce(o_orderstatus, 'Not officially analyzed yet') as official_disposition
  from best left join (select {_OFFICIAL_ID} as tic, o_orderstatus from orders) o on o.tic = tic_id)"""


@query(
    "results_table",
    f"with {_RESULTS} select tic_id, result, round(score, 6) as score, official_disposition from results",
)
def results_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_results(spark, folder))


@query(
    "results_inner",
    f"""with {_RESULTS} select tic_id, result, round(score, 6) as score, official_disposition from results
    where official_disposition <> 'Not officially analyzed yet'""",
)
def results_inner(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(results.results_table(_scores(spark, folder), _official(spark, folder), how="inner"))


_CODE = "case when o_orderpriority = '5-LOW' then null when o_orderstatus = 'F' then 'FP' when o_orderstatus = 'O' then 'KP' else 'odd' end"
_EVENT_SCORE = "case when o_orderkey % 5 = 0 then {nan} else o_totalprice / 400000 end"


@query(
    "results_repeated",
    f"""with best as (select o_custkey as tic_id, max(o_totalprice / 400000) as score from orders group by o_custkey),
    labels as (select o_custkey as tic_id, {_CODE} as label from orders),
    official as (select tic_id, arg_min(label, coalesce(case label when 'KP' then 0 when 'FP' then 5 end, 99)) as label
      from labels where label is not null group by tic_id)
    select tic_id, case when score <= 0.5 then 'False positive' when score <= 0.9 then 'Planetary candidate'
        else 'Confirmed planet' end as result, round(score, 6) as score,
      coalesce(label, 'Not officially analyzed yet') as official_disposition
    from best left join official using (tic_id)""",
)
def results_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Targets with many scores and many dispositions each: one row a target, its best label."""
    orders = table(spark, folder, "orders")
    scores = orders.select(F.col("o_custkey").alias("target_id"), (F.col("o_totalprice") / 400000).alias("score"))
    return rounded(results.results_table(scores, orders.select(F.col("o_custkey").alias("tic"), F.expr(_CODE).alias("disposition"))))


@query(
    "results_nan",
    f"""with events_ as (select o_custkey as tic_id, {_EVENT_SCORE.format(nan="null")} as score from orders),
    best as (select tic_id, max(score) as score from events_ group by tic_id)
    select tic_id, case when score is null then null when score <= 0.5 then 'False positive'
      when score <= 0.9 then 'Planetary candidate' else 'Confirmed planet' end as result, round(score, 6) as score,
      (select count(*) from events_ where score > 0.8) as high,
      (select round(avg(score), 6) from events_) as average from best""",
)
def results_nan(spark: SparkSession, folder: str) -> DataFrame:
    """A score of NaN is no score."""
    score = F.expr(_EVENT_SCORE.format(nan="double('NaN')")).alias("score")
    events = table(spark, folder, "orders").select(F.col("o_custkey").alias("tic_id"), score)
    high = results.high_scores(events).agg(F.count("*")).scalar()
    average = results.catalogue_summary(events).select("average_score").scalar()
    return rounded(results.best_score(events, "tic_id").select("*", high.alias("high"), average.alias("average")))


@query(
    "results_summary",
    f"""with {_RESULTS} select count(*) as total,
      count(*) filter (result = 'Confirmed planet') as confirmed_count,
      count(*) filter (result = 'Planetary candidate') as candidates_count,
      count(*) filter (result = 'False positive') as false_positives_count,
      round(avg(score), 6) as avg_score from results""",
)
def results_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(results.results_summary(_results(spark, folder)))


@query(
    "confirmed_results",
    f"""with {_RESULTS} select case result when 'Confirmed planet' then 'confirmed' when 'Planetary candidate' then 'candidates'
      else 'false_positives' end as class, tic_id, result, round(score, 6) as score, official_disposition from results""",
)
def confirmed_results(spark: SparkSession, folder: str) -> DataFrame:
    parts = results.split_by_class(_results(spark, folder))
    return rounded(catalog.concat_by_name([rows.withColumn("class", F.lit(name)) for name, rows in parts.items()]))


@query(
    "result_report",
    f"""with {_RESULTS}, s as (select count(*) as total, count(*) filter (result = 'Confirmed planet') as confirmed_count,
        count(*) filter (result = 'Planetary candidate') as candidates_count,
        count(*) filter (result = 'False positive') as false_positives_count, round(avg(score), 6) as avg_score from results)
    select *, (select count(*) from lineitem) as total_objects, (select count(distinct l_orderkey) from lineitem) as unique_stars
    from s""",
)
def result_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a scoring run: summary of the results and of the catalogue."""
    catalogue = _scores(spark, folder).withColumnRenamed("target_id", "tic_id")
    report = jobs.result_report(_scores(spark, folder), _official(spark, folder), catalogue)
    sizes = [report["catalogue"].select(c).scalar().alias(c) for c in ("total_objects", "unique_stars")]
    return rounded(report["summary"].select("*", *sizes))


@query("size_mb", "select l_orderkey, l_linenumber, round(cast(l_extendedprice * 1000 as bigint) / 1048576, 2) as size from lineitem")
def size_mb(spark: SparkSession, folder: str) -> DataFrame:
    size = S.size_mb((F.col("l_extendedprice") * 1000).cast("bigint")).alias("size")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", size)


@query(
    "catalogue_summary",
    """select count(*) as total_objects, count(distinct l_orderkey) as unique_stars,
      count(*) filter (l_discount * 10 > 0.8) as high_confidence_candidates,
      round(avg(l_discount * 10), 6) as average_score from lineitem""",
)
def catalogue_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(results.catalogue_summary(_scores(spark, folder).withColumnRenamed("target_id", "tic_id")))


@query(
    "high_scores",
    "select l_orderkey as target_id, round(l_discount * 10, 6) as score from lineitem where l_discount * 10 > 0.8",
)
def high_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(results.high_scores(_scores(spark, folder)))


_LEFT_LABEL = "case o_orderstatus when 'F' then 'KP' when 'O' then 'PC' end"
_RIGHT_LABEL = """case c_mktsegment when 'AUTOMOBILE' then 'CP' when 'FURNITURE' then 'EB'
  when 'HOUSEHOLD' then 'FA' else 'not a code' end"""


# Every row takes part; some under ids that the other side lacks.
_LEFT_ID = "case when o_orderpriority = '5-LOW' then -o_custkey else o_custkey end"
_RIGHT_ID = "case when c_mktsegment = 'BUILDING' then c_custkey + 1000000000 else c_custkey end"


def _rank_sql(label: str) -> str:
    whens = " ".join(f"when '{c}' then {i}" for i, c in enumerate(fv.LABEL_PRIORITY))
    return f"case when {label} is null then null else coalesce(case {label} {whens} end, 99) end"


def _sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, folder, "orders").select(F.expr(_LEFT_ID).alias("tic"), F.expr(_LEFT_LABEL).alias("disposition"))
    right = table(spark, folder, "customer").select(F.expr(_RIGHT_ID).alias("tic"), F.expr(_RIGHT_LABEL).alias("disposition"))
    return left, right


_NAMES = " ".join(f"when '{c}' then '{n}'" for c, n in fv.LABEL_NAMES.items())
_PICK = f"""select coalesce(l.tic, r.tic) as tic,
    case when l.label is null then r.label when r.label is null then l.label
      when {_rank_sql("l.label")} <= {_rank_sql("r.label")} then l.label else r.label end as code
  from l full join r on l.tic = r.tic"""
_LEFT = f"select {_LEFT_ID} as tic, {_LEFT_LABEL} as label from orders"
_RIGHT = f"select {_RIGHT_ID} as tic, {_RIGHT_LABEL} as label from customer"


@query(
    "best_disposition",
    f"""with source as ({_LEFT}),
    l as (select tic, label from (select tic, label, row_number() over (
      partition by tic order by coalesce({_rank_sql("label")}, 100), label) as n from source) where n = 1),
    r as ({_RIGHT}), picked as ({_PICK})
    select tic, coalesce(case code {_NAMES} end, code) as disposition from picked""",
)
def best_disposition(spark: SparkSession, folder: str) -> DataFrame:
    return results.best_disposition(*_sources(spark, folder))


@query(
    "disposition_pairs",
    f"""with l as ({_LEFT}), r as ({_RIGHT}), picked as ({_PICK})
    select tic, coalesce(case code {_NAMES} end, code) as disposition, count(*) as pairs from picked group by all""",
)
def disposition_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return results.disposition_pairs(*_sources(spark, folder))


# --- scored rows built from the order lines -------------------------------------------------------

_PREDICTED = "case l_returnflag when 'A' then 'CONFIRMED' when 'N' then 'CANDIDATE' else 'FALSE POSITIVE' end"
_CONFIDENCE = "1 - l_discount * 3"


def _scored(spark: SparkSession, folder: str, confidence: str = _CONFIDENCE) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("kepoi_name"),
        F.col("l_quantity").alias("koi_period"),
        F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("koi_prad"),
        F.expr("case when l_linestatus = 'O' then 'CANDIDATE' end").alias("original_label"),
        F.expr(_PREDICTED).alias("predicted_label"),
        F.expr(confidence).alias("confidence"),
        F.create_map(F.lit("CONFIRMED"), F.expr(confidence)).alias("probabilities"),
    )


_VETTED = f"""vetted as (select l_orderkey || '-' || l_linenumber as name,
  case when l_linestatus = 'O' then 'CANDIDATE' else 'UNKNOWN' end as original_status,
  {_PREDICTED} as predicted_status, {_CONFIDENCE} as confidence, l_quantity as period,
  case when l_linestatus = 'O' then l_tax end as radius,
  {_PREDICTED} in ('CONFIRMED', 'CP', 'Confirmed') and {_CONFIDENCE} > 0.70 as confirmable from lineitem)"""


def _vetted(spark: SparkSession, folder: str) -> DataFrame:
    return vetting.vet(_scored(spark, folder), "kepoi_name")


@query(
    "vetting",
    f"""with {_VETTED} select name, original_status, predicted_status, round(confidence, 6) as confidence,
      period, radius, confirmable from vetted""",
)
def vetting_records(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        _vetted(spark, folder).select(
            "name", "original_status", "predicted_status", "confidence",
            "characteristics.period", "characteristics.radius", "confirmable",
        )
    )


@query(
    "vetting_nan",
    f"""with rows_ as (select {_PREDICTED} as label, case when l_tax > 0.04 then null else {_CONFIDENCE} end as confidence
      from lineitem),
    flags as (select *, coalesce(label = 'CONFIRMED' and confidence > 0.70, false) as yes from rows_)
    select count(*) as total_analyzed, count(*) filter (yes) as confirmed_count, count(*) filter (not yes) as rejected_count,
      round(count(*) filter (yes) / count(*), 6) as confirmation_rate,
      (select round(avg(confidence) * count(confidence) / count(*), 3) from rows_) as average_confidence from flags""",
)
def vetting_nan(spark: SparkSession, folder: str) -> DataFrame:
    """A confidence of NaN confirms nothing and adds nothing."""
    scored = _scored(spark, folder, f"case when l_tax > 0.04 then double('NaN') else {_CONFIDENCE} end")
    summary = rounded(vetting.vetting_summary(vetting.vet(scored, "kepoi_name")))
    average = vetting.prediction_summary(scored).agg(F.max("average_confidence")).scalar()
    return summary.select("*", average.alias("average_confidence"))


@query(
    "vetting_summary",
    f"""with {_VETTED} select count(*) as total_analyzed, count(*) filter (confirmable) as confirmed_count,
      count(*) filter (not confirmable) as rejected_count,
      round(count(*) filter (confirmable) / count(*), 6) as confirmation_rate from vetted""",
)
def vetting_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(vetting.vetting_summary(_vetted(spark, folder)))


@query(
    "vetting_rejected",
    f"""with {_VETTED} select name, round(confidence, 6) as confidence from vetted where not confirmable
    order by name, vetted.confidence limit 100""",
)
def vetting_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(vetting.rejected(_vetted(spark, folder)).select("name", "confidence"))


@query(
    "prediction_summary",
    f"""with scored as (select {_PREDICTED} as class, {_CONFIDENCE} as confidence from lineitem),
    whole as (select count(*) as processed, round(avg(confidence), 3) as average_confidence from scored)
    select class, count(*) as "count", any_value(processed) as processed,
      any_value(average_confidence) as average_confidence, 1.0::double as success_rate
    from scored, whole group by class""",
)
def prediction_summary(spark: SparkSession, folder: str) -> DataFrame:
    return vetting.prediction_summary(_scored(spark, folder))


@query(
    "export_confirmed",
    f"""with {_VETTED} select name as "Nom", original_status as "Statut Original",
      printf('%.1f%%', confidence * 100) as "Confiance", printf('%.3f', period) as "Période (j)",
      coalesce(printf('%.2f', radius), 'N/A') as "Rayon (R⊕)" from vetted where confirmable""",
)
def export_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.confirmed_rows(_vetted(spark, folder))


@query(
    "export_scores",
    f"""with {_RESULTS} select
      case result when 'Confirmed planet' then 1 when 'Planetary candidate' then 2 else 3 end as class_group,
      tic_id as "TIC ID",
      case result when 'Confirmed planet' then 'Confirmée' when 'Planetary candidate' then 'Candidate'
        else 'Faux Positif' end as "Résultat", printf('%.3f', score) as "Score" from results""",
)
def export_scores(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.score_rows(_results(spark, folder))


@query(
    "probability_map",
    """with cells as (select vec_id, unnest(range(64)) as i, unnest(embedding) as score, list_max(embedding) as best from embeddings)
    select vec_id, 'd' || i as label, round(cast(score as double), 6) as score, round(cast(best as double), 6) as confidence
    from cells""",
)
def probability_map(spark: SparkSession, folder: str) -> DataFrame:
    scores = F.transform("embedding", lambda x: x.cast("double"))
    labelled = table(spark, folder, "embeddings").select(
        "vec_id",
        S.label_scores([f"d{i}" for i in range(64)], scores).alias("probabilities"),
        F.array_max(scores).alias("confidence"),
    )
    return rounded(labelled.select("vec_id", F.explode("probabilities").alias("label", "score"), "confidence"))


@query(
    "characteristics",
    """select p_partkey, round(case when p_type = 'SMALL' then
        case when p_size > 25 then p_retailprice / 2 else p_retailprice end else p_size end, 6) as period,
      case when p_size > 25 then p_retailprice end as duration, null::double as depth,
      p_size::double as radius from part""",
)
def characteristics(spark: SparkSession, folder: str) -> DataFrame:
    objects = table(spark, folder, "part").select(
        "p_partkey",
        F.expr("case when p_type <> 'SMALL' then p_size end").alias("koi_period"),
        F.expr("case when p_size > 25 then p_retailprice / 2 else double('NaN') end").alias("pl_orbper"),
        F.col("p_retailprice").alias("orbital_period"),
        F.expr("case when p_size > 25 then p_retailprice else double('NaN') end").alias("pl_trandurh"),
        F.expr("case when p_size > 25 then 'text' end").alias("koi_depth"),
        F.col("p_size").cast("string").alias("pl_rade"),
    )
    found = objects.withColumn("c", S.characteristics(objects))
    return rounded(found.select("p_partkey", "c.period", "c.duration", "c.depth", "c.radius"))


@query(
    "nan_to_null",
    """select p_partkey, case when p_size > 25 then p_retailprice end as price,
      case when p_size > 25 then p_retailprice end as nested from part""",
)
def nan_to_null(spark: SparkSession, folder: str) -> DataFrame:
    price = "case when p_size > 25 then p_retailprice else double('NaN') end"
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey", f"{price} as price", f"array(named_struct('x', {price})) as cells"
    )
    return S.nan_to_null(rows).selectExpr("p_partkey", "price", "cells[0].x as nested")


@query(
    "object_lookup",
    "select * from customer where c_name = 'Customer#000000042' order by c_custkey limit 1",
)
def object_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return formats.find_object(table(spark, folder, "customer"), "Customer#000000042", ["c_custkey"], "c_name")


_MARKED = "case when p_size > 40 then null when p_type = 'SMALL' then concat('#', p_name) else p_name end"


@query(
    "comment_rows",
    f"""select name, p_partkey from (select {_MARKED} as name, p_partkey from part) where not starts_with(name, '#')""",
)
def comment_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.expr(_MARKED).alias("name"), "p_partkey")
    return catalog.drop_hash_rows(rows)
