"""Checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share.

    Where it is unset, a folder of our own, if driver and executors are one process; on a cluster,
    which could not read that folder, an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trendlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, eager; never a local one, as executors can be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
