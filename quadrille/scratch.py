"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory. Where it names none, a temporary folder is set once on a local master (tests, a
    laptop); on a cluster that is an error, as other machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quadrille-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted with the other scratch tables."""
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, by: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back; ``by`` names columns whose values get folders of their own,
    ``most`` is the number of rows in a file (0: any).

    A lost executor costs no recomputation of what lies before, and a plan that uses the result twice runs
    what made it once. The tables go when the driver ends, or by :func:`release`.
    """
    path = scratch_path(df.sparkSession)
    df.write.options(compression="zstd", maxRecordsPerFile=most).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables made so far. Frames that read them can't be used any more."""
    sc = spark.sparkContext if spark is not None else SparkContext._active_spark_context
    while _made and sc is not None and sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        release()
