"""Cutting lineage in loops, in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of its own only where none is set and the session runs on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df without its history, as a Parquet table in the shared folder: computed once, and kept if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def every_few(df: DataFrame, i: int, k: int) -> DataFrame:
    """cut() after every k-th pass of a loop."""
    return cut(df) if i % k == k - 1 else df
