"""What the operators of this subpackage share: tables, cut lineage, batches and rows kept whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The input row travels under this name, so no column that a caller brings can clash.
ROW = "__input_row"

#: Bytes of a batch of rows between Spark and Python, and Spark's name for this bound (64 MB unless it is set).
BATCH_BYTES, BATCH_BOUND = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's tasks hand rows to Python in batches of about BATCH_BYTES; a bound that it sets itself stays.

    Both sides of a task hold its batch and what is made of it several times over, outside the heap.
    """
    if spark.conf.get(BATCH_BOUND, None) is None:
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing.

    Later reads take the columns that they need. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole input row as one struct, beside columns derived from it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *extra)


def numbered(docs: DataFrame, doc_id: str) -> DataFrame:
    """id and number (long) of every distinct id, numbered in their order; written, so numbers stay as they are."""
    ids = docs.select(F.col(f"`{doc_id}`").alias("id")).where("id is not null").distinct().orderBy("id")
    return written(ids.withColumn("number", F.monotonically_increasing_id()), "numbers")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive slices of sorted batches that share their keys, as (key, slice); a key may come in several slices."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], batch.num_rows)
        for a, b in zip(starts.tolist(), ends.tolist()):
            yield tuple(c[a].item() for c in cols), batch.slice(a, b - a)
