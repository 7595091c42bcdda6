"""Views on the dataset and job registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def newest_first(entries: DataFrame, date: str = "created_at", then_by: Sequence[str] = ()) -> DataFrame:
    """Entries by date text, newest first; entries without a date come last."""
    return entries.orderBy(F.coalesce(F.col(date).cast("string"), F.lit("")).desc(), *then_by)


def _time(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _seconds(start: Column, end: Column) -> Column:
    """Seconds between two times without a zone, with fractions."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1_000_000


def job_status(jobs: DataFrame, now: str) -> DataFrame:
    """Status view of every job; the duration of a running job is measured up to ``now``."""
    started = _time(F.col("started_at"))
    running = (F.col("status") == "running") & started.isNotNull()
    stored = F.coalesce(F.col("duration_seconds"), F.lit(0.0))
    duration = F.when(running, _seconds(started, F.lit(now).cast("timestamp_ntz"))).otherwise(stored)
    return jobs.withColumns(
        {"duration_seconds": duration, "progress": F.coalesce(F.col("progress"), F.lit(0))}
    )


def cleanup_candidates(
    jobs: DataFrame, now: str, days: int = fv.KEEP_DAYS, statuses: Sequence[str] = fv.FINISHED_STATUSES
) -> DataFrame:
    """Finished jobs older than ``days`` whole days; a job without a readable date is kept."""
    age = F.timestamp_diff("DAY", _time(F.col("created_at")), F.lit(now).cast("timestamp_ntz"))
    return jobs.filter(F.col("status").isin(*statuses) & (age > days))
