"""Cutting the lineage of iterative plans, and folders for tables that a query writes for itself."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only in local mode, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "evidara-checkpoints"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
