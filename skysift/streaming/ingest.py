"""Incremental ingest: every run takes up the files it has not seen and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir
from ..sources import downloads, fits
from . import segments

# Bytes of files in a batch, unless a number of files is given.
BYTES_PER_BATCH = 64 * 2**30
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(
    spark: SparkSession, folder: str, pattern: str = "*.fits", files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> DataFrame:
    """New binary files of a folder as a stream of (filename, content)."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("pathGlobFilter", pattern)
        .option(*_limit(files_per_batch, bytes_per_batch))
        .load(folder)
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def _limit(files: int | None, size: int) -> tuple[str, str]:
    return ("maxFilesPerTrigger", str(files)) if files is not None else ("maxBytesPerTrigger", str(size))


def _run(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _checkpoint(spark: SparkSession, given: str | None, name: str) -> str:
    return f"{(given or shared_dir(spark)).rstrip('/')}/{name}"


def ingest_light_curves(
    spark: SparkSession,
    folder: str,
    out: str,
    schema: str | T.StructType,
    name: str,
    checkpoint: str | None = None,
    files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> StreamingQuery:
    """Append unseen light curves to ``out``/curves (by SECTOR and batch) and their status to ``out``/status (by batch).

    ``name`` identifies the ingest: a later run under the same name goes on where the last one stopped, also
    after a crash. Every file is read and decoded once a batch; a batch that is run again replaces its own
    partitions of both tables, so they always agree. :func:`compact_light_curves` merges the batches;
    ``segments.read`` reads both tables before and after.
    """
    base = _checkpoint(spark, checkpoint, name)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(files: DataFrame, batch: int) -> None:
        decoded = f"{base}/decoded"
        fits.decode_files(files, fields).write.mode("overwrite").parquet(decoded)
        done = spark.read.parquet(decoded)
        points = done.filter("points is not null").select(
            F.explode("points").alias("p"), F.col("tic").alias("TIC"), F.col("sector").alias("SECTOR")
        )
        # Few files a sector, and none of them too large: rows of a large sector are spread.
        curves = points.select("p.*", "TIC", "SECTOR").hint("rebalance", "SECTOR")
        segments.replace_batch(curves, f"{out}/curves", batch, ["SECTOR"])
        segments.replace_batch(done.drop("points"), f"{out}/status", batch)

    files = stream_files(spark, folder, files_per_batch=files_per_batch, bytes_per_batch=bytes_per_batch)
    return _by_batch(files, write, out, base)


def _by_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], out: str, base: str) -> StreamingQuery:
    """Take up what is new, a batch at a time; a batch that a segment holds already is not written again."""

    def unless_merged(rows: DataFrame, batch: int) -> None:
        if not segments.holds(stream.sparkSession, out, batch):
            write(rows, batch)

    writer = stream.writeStream.foreachBatch(unless_merged).option("checkpointLocation", f"{base}/marks")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def compact_light_curves(spark: SparkSession, out: str, least: int = 2) -> segments.Segment | None:
    """Merge the batches of :func:`ingest_light_curves`, if ``least`` or more came in since the last time."""
    return segments.compact(spark, out, {"curves": ["SECTOR"], "status": []}, least)


def ingest_script_batches(
    spark: SparkSession,
    folder: str,
    out: str,
    name: str,
    checkpoint: str | None = None,
    pattern: str = "*lc.sh",
    files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> StreamingQuery:
    """Append the targets of unseen download scripts to ``out``/targets and their number to ``out``/scripts, by batch.

    A script without any target has its row with 0. A batch that runs again replaces itself, as for light curves;
    :func:`compact_scripts` merges the batches and ``segments.read`` reads the tables.
    """

    def write(lines: DataFrame, batch: int) -> None:
        targets = downloads.targets_in_lines(lines)
        segments.replace_batch(targets, f"{out}/targets", batch)
        counts = targets.groupBy("script").agg(F.count("*").alias("targets"))
        counted = lines.select("script").distinct().join(counts, "script", "left")
        segments.replace_batch(counted.select("script", F.coalesce("targets", F.lit(0)).alias("targets")), f"{out}/scripts", batch)

    lines = _script_lines(spark, folder, pattern, files_per_batch, bytes_per_batch)
    return _by_batch(lines, write, out, _checkpoint(spark, checkpoint, name))


def compact_scripts(spark: SparkSession, out: str, least: int = 2) -> segments.Segment | None:
    """Merge the batches of :func:`ingest_script_batches`, if ``least`` or more came in since the last time."""
    return segments.compact(spark, out, {"targets": [], "scripts": []}, least)


def _script_lines(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None, bytes_per_batch: int) -> DataFrame:
    """Lines of unseen scripts as a stream of (value, script)."""
    lines = (
        spark.readStream.format("text")
        .option("pathGlobFilter", pattern)
        .option(*_limit(files_per_batch, bytes_per_batch))
        .load(folder)
    )
    return lines.select("value", F.col("_metadata.file_name").alias("script"))


def ingest_scripts(
    spark: SparkSession,
    folder: str,
    out: str,
    name: str,
    checkpoint: str | None = None,
    pattern: str = "*lc.sh",
    files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> StreamingQuery:
    """Append the targets of unseen download scripts to ``out``."""
    rows = _script_lines(spark, folder, pattern, files_per_batch, bytes_per_batch)
    query = _run(downloads.targets_in_lines(rows), out, _checkpoint(spark, checkpoint, name))
    query.awaitTermination()
    return query
