"""Change events: append by batch, read back, exchange with existing event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import times as D
from driftmark.functions import variant as V
from driftmark.operators import events as E
from driftmark.sources.bundles import read_documents


def batch_id(detected_at: Column) -> Column:
    """Batch name from its time, without punctuation."""
    return D.compact_timestamp(detected_at)


def append_events(events: DataFrame, root: str, batch: str) -> int:
    """Write one batch; writing the same batch again replaces it.  Returns the number of events.

    A batch of no events has metadata too, so that a rerun without events leaves none of an earlier run's.
    """
    seen = Observation()
    counted = events.observe(seen, F.count(F.lit(1)).alias("n"), F.min("detected_at").alias("t"))
    counted.write.mode("overwrite").parquet(f"{root}/events/batch_id={batch}")
    count = seen.get["n"]
    meta = events.sparkSession.range(1).select(
        F.lit(seen.get["t"]).cast("string").alias("created_at"), F.lit(count).cast("bigint").alias("event_count")
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/batch_id={batch}")
    return count


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """All stored events with their `batch_id`."""
    return spark.read.option("basePath", f"{root}/events").option("mergeSchema", "true").parquet(f"{root}/events")


def read_batch(spark: SparkSession, root: str, batch: str) -> DataFrame:
    """The events of one batch; no other partition is opened."""
    return spark.read.option("basePath", f"{root}/events").parquet(f"{root}/events/batch_id={batch}")


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """Batches that hold events."""
    return spark.read.option("basePath", f"{root}/batches").parquet(f"{root}/batches").filter("event_count > 0")


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Events of `{created_at, event_count, events: [...]}` files in the fixed schema.

    Entries that are not objects are skipped; `_source_file` names the file and `_place` the place in it.
    """
    docs = read_documents(spark, path)
    rows = docs.select(
        F.col("file").alias("_source_file"), F.posexplode(V.as_list(V.member(F.col("doc"), "events"))).alias("_place", "event")
    )
    return E.unify_event_names(rows.filter(V.as_object(F.col("event")).isNotNull()))


def write_event_files(events: DataFrame, path: str) -> None:
    """Export under the names of existing event files, one JSON object per line."""
    E.legacy_events(events).write.mode("overwrite").json(path)
