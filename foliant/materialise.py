"""Cutting lineage, so that rows keep the partitions and order they once had."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a folder of our own only in local mode, where it is unset."""
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return shared_folder(spark)


def materialised(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; they keep the partitions and order that they have now."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
