"""Cutting lineage where a result is used several times, and folders for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A cluster without one is refused; only a local session without one gets a
    temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="grootboek-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder, which the driver and all executors share, below the checkpoint folder."""
    return f"{_shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, so later steps and lost executors read it from there."""
    _shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new shared folder: smaller than a checkpoint, and later steps read only the columns
    that they use. Rows come back in any order."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
