"""Summaries of light curves and of ingest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def lightcurve_summary(curves: DataFrame, tic: str = "TIC", sector: str = "SECTOR") -> DataFrame:
    """One row: total_rows, targets, sectors, the smallest and largest target and the sector list.

    The points are first counted per (target, sector); targets and sectors are then counted
    on the short table of curves. The sector list is as long as there are sectors.
    """
    curve = curves.groupBy(F.col(tic).alias("t"), F.col(sector).alias("s")).agg(F.count("*").alias("n"))
    sectors = curve.groupBy("s").agg(F.lit(1).alias("one")).agg(
        F.struct(F.count("s").alias("sectors"), F.array_sort(F.collect_list("s")).alias("sector_list"))
    )
    targets = curve.groupBy("t").agg(F.sum("n").alias("n"))
    summary = targets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("t").alias("targets"),
        F.min("t").alias("tic_min"),
        F.max("t").alias("tic_max"),
    )
    return summary.select("*", sectors.scalar().alias("r")).select(
        "total_rows", "targets", "r.sectors", "tic_min", "tic_max", "r.sector_list"
    )


def status_summary(status: DataFrame, size: str | None = None) -> DataFrame:
    """(status, files, size) of an ingest run; ``size`` names the column to add up."""
    amount = F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0).cast("bigint")
    return status.groupBy("status").agg(F.count("*").alias("files"), amount.alias("size"))


def file_sizes(files: DataFrame) -> DataFrame:
    """(name, path, size_mb) of files listed through a binary-file scan."""
    return files.select(
        S.base_name(F.col("path")).alias("name"), "path", S.size_mb(F.col("length")).alias("size_mb")
    )
