"""Dispositions of two sources, score results per target, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import scalars as S


def best_per_target(source: DataFrame, key: str = "tic", label: str = "disposition") -> DataFrame:
    """One row per target: its label of highest priority; ties by label text.

    Every task first reduces its rows to (target, label) by hashing; only these few are ordered.
    """
    rank = F.coalesce(S.label_rank(F.col(label)), F.lit(S.UNKNOWN_RANK + 1))
    best = F.min(F.struct(rank.alias("rank"), F.col(label).alias("label")))
    # The filter holds for every group; without it the optimizer would merge the two aggregates into a sorting one.
    kinds = source.groupBy(key, label).agg(F.count("*").alias("rows")).where("rows > 0")
    return kinds.groupBy(key).agg(best.alias("best")).select(key, F.col("best.label").alias(label))


def best_disposition(left: DataFrame, right: DataFrame, key: str = "tic", label: str = "disposition") -> DataFrame:
    """Label of higher priority of two sources, as long name; the left source wins a tie.

    Targets of either source are kept, one row each.
    """
    joined = _side(best_per_target(left, key, label), key, label, "l").join(
        _side(best_per_target(right, key, label), key, label, "r"), key, "full"
    )
    return joined.select(key, S.label_name(S.better_label(F.col("l"), F.col("r"))).alias(label))


def disposition_pairs(left: DataFrame, right: DataFrame, key: str = "tic", label: str = "disposition") -> DataFrame:
    """(key, label, pairs): how often each label wins when every left row of a target meets every right row.

    The rows are counted per target and label before they meet, so the pairs themselves
    are never built.
    """
    sides = [
        _side(side.groupBy(key, label).agg(F.count("*").alias(n)), key, label, name, n)
        for side, name, n in ((left, "l", "nl"), (right, "r", "nr"))
    ]
    joined = sides[0].join(sides[1], key, "full")
    pairs = F.coalesce("nl", F.lit(1)) * F.coalesce("nr", F.lit(1))
    winner = S.label_name(S.better_label(F.col("l"), F.col("r"))).alias(label)
    return joined.select(key, winner, pairs.alias("pairs")).groupBy(key, label).agg(F.sum("pairs").alias("pairs"))


def _side(df: DataFrame, key: str, label: str, name: str, *rest: str) -> DataFrame:
    return df.select(key, F.col(label).alias(name), *rest)


def best_score(scores: DataFrame, target: str = "target_id", score: str = "score") -> DataFrame:
    """(tic_id, result, score): the highest score of each target and its class; NaN counts as missing."""
    best = scores.groupBy(F.col(target).alias("tic_id")).agg(F.max(S.valid_double(F.col(score))).alias("score"))
    return best.select("tic_id", S.score_class(F.col("score")).alias("result"), "score")


def results_table(scores: DataFrame, dispositions: DataFrame, how: str = "left") -> DataFrame:
    """(tic_id, result, score, official_disposition) per target.

    ``scores`` has (target_id, score), ``dispositions`` (tic, disposition). Targets without
    a disposition get the default text, or are left out with ``how='inner'``. Of several dispositions of a
    target the one of highest priority counts, so there is one row per target.
    """
    official = best_per_target(dispositions).select(
        F.col("tic").alias("tic_id"), F.col("disposition").alias("official_disposition")
    )
    return (
        best_score(scores)
        .join(official, "tic_id", how)
        .withColumn("official_disposition", F.coalesce("official_disposition", F.lit(fv.NOT_ANALYZED)))
    )


def split_by_class(results: DataFrame) -> dict[str, DataFrame]:
    """Confirmed, candidate and false-positive rows as three frames."""
    classes = {"confirmed": fv.CONFIRMED, "candidates": fv.CANDIDATE, "false_positives": fv.FALSE_POSITIVE}
    return {name: results.filter(F.col("result") == text) for name, text in classes.items()}


def results_summary(results: DataFrame) -> DataFrame:
    """One row: total, rows per class and the mean score."""
    result = F.col("result")
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(result == fv.CONFIRMED).alias("confirmed_count"),
        F.count_if(result == fv.CANDIDATE).alias("candidates_count"),
        F.count_if(result == fv.FALSE_POSITIVE).alias("false_positives_count"),
        F.avg(S.valid_double(F.col("score"))).alias("avg_score"),
    )


def score_column(df: DataFrame) -> str | None:
    """First column whose name contains 'score', if it is numeric."""
    name = next((c for c in df.columns if "score" in c.lower()), None)
    return name if name is not None and isinstance(df.schema[name].dataType, T.NumericType) else None


def high_scores(df: DataFrame, above: float = fv.HIGH_SCORE_ABOVE) -> DataFrame:
    """Rows with a score strictly above the bound; none without a score column, and NaN is no score."""
    name = score_column(df)
    return df.filter(F.lit(False) if name is None else S.valid_double(F.col(f"`{name}`")) > above)


def catalogue_summary(df: DataFrame, star: str = "tic_id") -> DataFrame:
    """One row: total_objects, unique_stars, high_confidence_candidates, average_score.

    The table is first reduced to one row per star, so no task counts distinct values of
    the whole table.
    """
    name = score_column(df)
    score = S.valid_double(F.col(f"`{name}`")) if name else F.lit(None).cast("double")
    by_star = [F.col(f"`{star}`")] if star in df.columns else [F.lit(None).cast("bigint").alias(star)]
    stars = df.groupBy(*by_star).agg(
        F.count("*").alias("n"),
        F.count_if(score > fv.HIGH_SCORE_ABOVE).alias("high"),
        F.sum(score).alias("sum"),
        F.count(score).alias("scored"),
    )
    return stars.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_objects"),
        F.count(star).alias("unique_stars"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_confidence_candidates"),
        F.try_divide(F.sum("sum"), F.sum("scored")).alias("average_score"),
    )
