"""Session helpers: where a job may keep intermediate data."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of rows handed to a Python worker at once. Files and texts are long: by rows alone a batch could fill its memory.
BATCH_BYTES = 4 * 2**20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
# Tables written by this process and not yet removed.
_STAGED: list[str] = []
# The folder of a session on one machine for which none is named.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Where none is named, a session without other machines (``local``) uses a folder of its own, removed at the
    end; any other must name one.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} is not set; name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="skysift-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = _OWN[0]
    return folder.rstrip("/")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; :func:`release` removes it and what was written there."""
    path = f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def bound_batches(spark: SparkSession) -> None:
    """Set the session's size of batches for Python workers: at most BATCH_BYTES, or one longer row."""
    if spark.conf.get(BATCH_KEY) != str(BATCH_BYTES):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, folder = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it exists."""
    fs, found = file_system(spark, path)
    fs.delete(found, True)


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Give a written file or folder its final name in one rename. The name must be new: nothing is replaced."""
    fs, source = file_system(spark, staged)
    _, target = file_system(spark, final)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise FileExistsError(f"{final} has been published already")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later passes do not redo its lineage.

    Unlike a cached frame, the written table outlives lost executors. :func:`release` removes it.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the tables staged so far, once nothing reads them any more; how many there were."""
    removed = 0
    while _STAGED:
        remove(spark, _STAGED.pop())
        removed += 1
    return removed
