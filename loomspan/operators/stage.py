"""Tables that are used several times are computed once and cut off from their plan.

A plan that uses a part several times repeats it, and parts of parts, so a run's
plan would grow without bound.  A checkpoint ends it; it lies in the folder that
spark.checkpoint.dir names, which executors share, so losing one costs nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomspan-"))
    return df.checkpoint()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    staged(spark.range(0))
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
