"""Target lists: sector runs, observation lookup and the intersection of two download lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import scalars as S
from ..sources.catalog import require_columns
from . import relational


def explode_sectors(targets: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(tic_id, sectors) to (tic_id, sector_run), one row per sector.

    ``sectors`` is an array, or text like '[11, 38]'. An empty list gives no row, or a row
    with a null run if ``keep_empty``.
    """
    sectors = F.col("sectors")
    if isinstance(targets.schema["sectors"].dataType, T.StringType):
        sectors = F.from_json(sectors, "array<int>")
    each = F.explode_outer(sectors) if keep_empty else F.explode(sectors)
    rows = targets.select("tic_id", each.alias("sector"))
    run = F.when(F.col("sector").isNotNull(), S.sector_run(F.col("sector")))
    return rows.select("tic_id", run.alias("sector_run"))


def observed_sectors(observations: DataFrame, targets: DataFrame | None = None, keep_missing: bool = False) -> DataFrame:
    """(tic_id, sectors): the sorted distinct sectors of each target.

    ``observations`` has (tic_id, sector). With ``targets`` only those are looked up; one
    without observations is dropped, or kept with an empty list if ``keep_missing``. A
    list is as long as the number of sectors, which is small: pairs are made distinct
    before they are gathered.
    """
    pairs = observations.select("tic_id", "sector").distinct()
    lists = pairs.groupBy("tic_id").agg(F.array_sort(F.collect_list("sector")).alias("sectors"))
    if targets is None:
        return lists
    wanted = targets.select("tic_id").distinct()
    if not keep_missing:
        return lists.join(wanted, "tic_id", "left_semi")
    empty = F.array().cast(lists.schema["sectors"].dataType)
    return wanted.join(lists, "tic_id", "left").select("tic_id", F.coalesce("sectors", empty).alias("sectors"))


def observed_runs(observations: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(tic_id, sector_run) of the observed sectors, without building lists in between."""
    pairs = observations.select("tic_id", "sector").distinct()
    if targets is not None:
        pairs = relational.rows_with_id(pairs, targets, "tic_id")
    return pairs.select("tic_id", S.sector_run(F.col("sector")).alias("sector_run"))


def prepare_targets(targets: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Run list of a target list with ``sector_run``, with ``sectors``, or with ids only (looked up)."""
    require_columns(targets, ["tic_id"])
    if "sector_run" in targets.columns:
        return targets.select("tic_id", "sector_run")
    if "sectors" in targets.columns:
        return explode_sectors(targets)
    if observations is None:
        raise ValueError("a list of ids only needs the observations to look up its sectors")
    return observed_runs(observations, targets)


def pair_targets(ids: DataFrame, id_array: str = "ids", sector_array: str = "sectors") -> DataFrame:
    """Rows (tic_id, sector) of arrays given side by side; rows whose lengths differ give none."""
    pairs = S.pair_by_position(F.col(id_array), F.col(sector_array))
    rows = ids.select(F.explode(pairs).alias("p"))
    return rows.select(F.col("p.id").alias("tic_id"), F.col("p.sector").alias("sector"))


def ids_in_text(texts: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Numeric tokens of free text, split at commas and white space, as rows with the key columns."""
    tokens = texts.select(*keys, F.explode(F.split(text, fv.ID_SEPARATORS)).alias("token"))
    numbers = S.with_column_once(tokens, "number", S.number_token(F.col("token")))
    return numbers.filter(F.col("number").isNotNull()).select(*keys, "number")


def target_list_summary(runs: DataFrame) -> DataFrame:
    """One row: total_tics, distinct_runs and the ten smallest ids, after a check of the columns."""
    require_columns(runs, ["tic_id", "sector_run"])
    smallest = runs.select("tic_id").orderBy("tic_id").limit(10)
    ten = smallest.agg(F.array_sort(F.collect_list("tic_id"))).scalar()
    per_run = runs.groupBy("sector_run").agg(F.count("*").alias("n"))
    return per_run.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tics"), F.count("sector_run").alias("distinct_runs")
    ).select("*", ten.alias("first_tic_ids"))


def distinct_runs(runs: DataFrame) -> DataFrame:
    """The different sector runs of a list, with first and last sector."""
    parsed = runs.select("sector_run").distinct().withColumn("p", S.parse_sector_run(F.col("sector_run")))
    return parsed.select("sector_run", "p.first_sector", "p.last_sector")


def first_per_target(targets: DataFrame, order_by: Sequence[str] = ("script", "place")) -> DataFrame:
    """Targets of the scripts, the first seen of each id."""
    return relational.keep_first(targets, ["tic"], list(order_by))


def intersect_targets(lc: DataFrame, dv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light-curve targets that also have validation files, sorted, and the comparison counts.

    Both inputs hold one row per ``tic``. The counts come from one full join of the ids.
    """
    kept = relational.rows_with_id(lc, dv, "tic").orderBy("tic")
    return kept, comparison_counts(lc, dv, "tic")


def comparison_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: left_only, right_only, common, left_total, right_total distinct ids."""
    sides = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionAll(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    l, r = F.col("l") == 1, F.col("r") == 1
    return sides.agg(
        F.count_if(l & ~r).alias("left_only"),
        F.count_if(r & ~l).alias("right_only"),
        F.count_if(l & r).alias("common"),
        F.count_if(l).alias("left_total"),
        F.count_if(r).alias("right_total"),
    )
