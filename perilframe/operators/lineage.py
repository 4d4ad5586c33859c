"""Reliable lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/perilframe-checkpoints"  # used only in local mode where a session names no folder, as in tests


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. A cluster must name one: a folder of one machine would not do."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or FALLBACK_DIR)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder the session names in spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. For loops: a checkpoint passes on size estimates, which multiply with each join."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
