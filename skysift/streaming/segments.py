"""Tables that grow by batches, merged into larger segments under a manifest.

An ingest writes each batch into folders of its own, ``<out>/<table>/…/batch=<n>``, and would leave small files for
ever. :func:`compact` writes the batches since the last segment, together with older segments that are not much
larger, as one new segment, so a row is rewritten a logarithmic number of times and the number of segments stays
logarithmic. A segment counts once a manifest names it. Manifests are numbered and published by one rename; the newest
one says which batches the segments hold, and all later batches are read from their own folders.

What a crash leaves is a segment that no manifest names. A batch that the stream runs again is written in place of
itself if no segment holds it, and left out if one does (:func:`holds`). One ingest, and no other writer, owns a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..sources.catalog import concat_by_name

#: Segments of up to so many times the rows behind them are merged with these.
GROWTH = 2


@dataclass(frozen=True)
class Segment:
    """Batches ``first`` to ``last`` of all tables, and their rows."""

    first: int
    last: int
    rows: int
    path: str


def replace_batch(rows: DataFrame, path: str, batch: int, partitions: Sequence[str] = ()) -> None:
    """Write the rows of one batch, in place of what an earlier run of the batch left."""
    writer = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions, "batch").parquet(path)


def _manifests(spark: SparkSession, out: str) -> list[str]:
    return [n for n in session.children(spark, f"{out}/_manifests") if n.startswith("manifest-")]


def _read(spark: SparkSession, out: str, name: str) -> list[Segment]:
    text = spark.read.text(f"{out}/_manifests/{name}").first()["value"]
    return [Segment(**s) for s in json.loads(text)]


def segments(spark: SparkSession, out: str) -> list[Segment]:
    """The segments of the newest manifest, oldest batches first; none before the first compaction."""
    names = _manifests(spark, out.rstrip("/"))
    return _read(spark, out.rstrip("/"), names[-1]) if names else []


def _through(found: Sequence[Segment]) -> int:
    """The last batch that the segments hold."""
    return found[-1].last if found else -1


def holds(spark: SparkSession, out: str, batch: int) -> bool:
    """Whether a segment holds the batch already."""
    return batch <= _through(segments(spark, out))


def read(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of an ingest, with the number of each row's ``batch``: its segments and the batches behind them."""
    parts = _parts(spark, out.rstrip("/"), table)
    if not parts:
        raise FileNotFoundError(f"no batch has written rows of {table} in {out}")
    return concat_by_name(parts)


def _parts(spark: SparkSession, out: str, table: str) -> list[DataFrame]:
    """What holds the rows of a table; nothing if no batch had any."""
    found = segments(spark, out)
    paths = [f"{out}/{s.path}/{table}" for s in found]
    parts = [spark.read.parquet(p) for p in paths if session.children(spark, p)]
    if _loose(spark, f"{out}/{table}", _through(found)):
        parts.append(spark.read.parquet(f"{out}/{table}").filter(F.col("batch") > _through(found)))
    return parts


def _loose(spark: SparkSession, path: str, through: int) -> list[int]:
    """The batches behind ``through`` that a table has folders of."""
    return sorted({b for b, _ in _batch_folders(spark, path) if b > through})


def _batch_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(batch, folder) of a table, below any partitions."""
    found = []
    for name in session.children(spark, path):
        if name.startswith("batch="):
            found.append((int(name.removeprefix("batch=")), f"{path}/{name}"))
        elif "=" in name:
            found += _batch_folders(spark, f"{path}/{name}")
    return found


def compact(spark: SparkSession, out: str, tables: Mapping[str, Sequence[str]], least: int = 2) -> Segment | None:
    """Merge the batches behind the last segment into one, if there are at least ``least`` of them.

    ``tables`` names the tables of the ingest and their partition columns; the one that is written last in a batch comes
    last, so that its folders tell which batches are whole. Folders that the manifest before the new one did not
    name any more are removed; those it named stay, as a reader may have begun with it.
    """
    out = out.rstrip("/")
    names = _manifests(spark, out)
    before = _read(spark, out, names[-1]) if names else []
    whole = _loose(spark, f"{out}/{list(tables)[-1]}", _through(before))
    if len(whole) < least:
        return None
    first, last = whole[0], whole[-1]
    parts = {t: _parts(spark, out, t) for t in tables}
    views = {t: concat_by_name(p).filter(F.col("batch") <= last) for t, p in parts.items() if p}
    rows = sum(v.filter(F.col("batch") >= first).count() for v in views.values())
    kept = list(before)
    while kept and kept[-1].rows <= GROWTH * rows:
        oldest = kept.pop()
        first, rows = oldest.first, rows + oldest.rows
    merged = Segment(first, last, rows, f"_segments/{first:08d}-{last:08d}-{uuid.uuid4().hex[:8]}")
    for table, view in views.items():
        partitions = tables[table]
        part = view.filter(F.col("batch") >= first).hint("rebalance", *partitions)
        writer = part.write
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{out}/{merged.path}/{table}")
    number = 1 + (int(names[-1].removeprefix("manifest-")) if names else 0)
    staged = f"{out}/_manifests/_staged-{uuid.uuid4().hex}"
    text = json.dumps([asdict(s) for s in [*kept, merged]])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(staged)
    session.publish(spark, staged, f"{out}/_manifests/manifest-{number:08d}")
    _sweep(spark, out, tables, before, [*kept, merged])
    return merged


def _sweep(spark: SparkSession, out: str, tables: Mapping[str, Sequence[str]], before: Sequence[Segment], now: Sequence[Segment]) -> None:
    """Remove segments and batch folders that neither of the last two manifests needs."""
    named = {s.path.removeprefix("_segments/") for s in [*before, *now]}
    for name in session.children(spark, f"{out}/_segments"):
        if name not in named:
            session.remove(spark, f"{out}/_segments/{name}")
    for table in tables:
        for batch, folder in _batch_folders(spark, f"{out}/{table}"):
            if batch <= _through(before):
                session.remove(spark, folder)
