"""The folder for checkpoints, which driver and executors share."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, local mode gets a temporary folder; a cluster gets an error,
    since no folder of one machine is visible to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its partitions written to the shared folder, in their order.

    The files go when the driver's Python ends, or by :func:`drop_checkpoints` when no frame made from them is used any more.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    made = df.checkpoint(eager=True)
    file = made._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        if not _made:
            atexit.register(_drop_at_exit)
        _made.append(file.get())
    return made


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete the files of all checkpoints made so far."""
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_checkpoints(spark)
        except Exception:  # the session may be closing; a left-over file does no harm
            return
