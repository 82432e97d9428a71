"""Cutting lineage where many branches start from one frame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """Writes the frame to the folder in spark.checkpoint.dir and goes on from there.

    Where that is unset, a local session (tests) takes a folder of its own; on a cluster, whose machines share no
    local folder, this is an error. Later plans begin at the written rows, so they stay small, and lost executors
    cost no rebuilding.
    """
    _ensure(df.sparkSession)
    return df.checkpoint(eager=True)


def _ensure(spark: SparkSession) -> str:
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below that folder."""
    return f"{_ensure(spark).rstrip('/')}/{name}-{uuid.uuid4()}"
