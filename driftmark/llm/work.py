"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftmark.session import new_work_dir

BATCH_BYTES = 8 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet files in the shared folder: a short lineage, narrow columns.

    A lost executor costs a reader nothing, since the files outlive it.
    """
    folder = new_work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session pass BATCH_BYTES by much: rows are texts, and a batch is held by both sides at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system at a task's end: its Python worker lives on, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)
