"""Cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; where it names none, one of this machine, in local mode alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="crawlgrain-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder, where lost executors don't lose them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
