"""The change feed over a stream of arriving entity versions.

Arriving data drives it instead of a schedule, in one of two modes.

*Versions*: each micro-batch of version rows is compared with the last known version of its
entities, which `KeyedState` keeps in buckets: a batch reads and rewrites the buckets of its own entities and no
others. Transitions, new versions and what the batch read are written under the batch id, so a batch that is
run again replaces what it wrote.

*Snapshots*: each snapshot that arrived as a whole is scanned against its stored predecessor, under
its snapshot id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftmark.operators.skew import OrderedKeys
from driftmark.plans import monitor
from driftmark.presets import DEFAULT, Profile
from driftmark.sources import snapshots
from driftmark.streaming.keyed_state import BUCKET_ROWS, KeyedState


def batch_transitions(batch: DataFrame, known: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], **skew) -> DataFrame:
    """Every row of the batch with struct `previous`: the version before it, in the batch or known.

    Only the first row of an entity in the batch needs the known version, so the join to it has one
    row per entity on both sides however many versions one entity has in the batch.
    """
    inside = OrderedKeys(batch, [entity], order, **skew).lag(columns, "previous")
    first = inside.filter("previous is null").drop("previous")
    rest = inside.filter("previous is not null")
    of_known = known.select(F.col(entity).alias("__entity"), F.col("version").alias("previous"))
    return rest.unionByName(first.join(of_known, F.col(entity).eqNullSafe(F.col("__entity")), "left").drop("__entity"))


def last_versions(batch: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return batch.groupBy(entity).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("version"))


def start_change_feed(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    entity: str,
    order: Sequence[str],
    columns: Sequence[str],
    bucket_rows: int = BUCKET_ROWS,
    **skew,
) -> StreamingQuery:
    """Start the feed: transitions go to `<root>/transitions`, last versions to `<root>/state`, costs to `<root>/costs`.

    Versions of one entity have to arrive in version order across batches (inside a batch any
    order will do).
    """
    kinds = dict(stream.dtypes)
    version = "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in columns) + ">"
    state = KeyedState(stream.sparkSession, f"{root}/state", kinds[entity], version, bucket_rows)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        fresh = last_versions(kept, entity, order, columns).withColumnRenamed(entity, "key").withColumnRenamed("version", "value")
        buckets = state.touched(fresh, batch_id)
        known = state.read(buckets).select(F.col("key").alias(entity), F.col("value").alias("version"))
        transitions = batch_transitions(kept, known, entity, order, columns, **skew)
        transitions.write.mode("overwrite").parquet(f"{root}/transitions/batch_id={batch_id}")
        state.write(batch_id, fresh, buckets)
        cost = state.spark.range(1).select(F.lit(len(buckets)).alias("buckets_read"), F.lit(sum(b.rows for b in buckets)).cast("bigint").alias("rows_read"))
        cost.coalesce(1).write.mode("overwrite").parquet(f"{root}/costs/batch_id={batch_id}")
        kept.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def last_known(spark: SparkSession, root: str, entity: str, kind: str, columns: str) -> DataFrame:
    """`(entity, version)` of every entity the feed has seen; kind and columns are the DDL types of the entity and its version."""
    state = KeyedState(spark, f"{root}/state", kind, f"struct<{columns}>")
    return state.all().select(F.col("key").alias(entity), F.col("value").alias("version"))


def read_costs(spark: SparkSession, root: str) -> DataFrame:
    """`(batch_id, buckets_read, rows_read)`: how much of the state each batch read."""
    return spark.read.option("basePath", f"{root}/costs").parquet(f"{root}/costs").select(F.col("batch_id").cast("bigint"), "buckets_read", "rows_read")


def read_transitions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/transitions").parquet(f"{root}/transitions").drop("batch_id")


def start_snapshot_feed(stream: DataFrame, root: str, checkpoint: str, profile: Profile = DEFAULT) -> StreamingQuery:
    """Scan arriving snapshots `(snapshot_id, created_at, pos, doc VARIANT)` in id order.

    A micro-batch has to hold whole snapshots, as files with one snapshot each do, and snapshots have
    to arrive in id order across batches.  The only thing the driver sees is the list of arrivals.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        arrived = kept.select("snapshot_id", "created_at").distinct().orderBy("snapshot_id").collect()
        for row in arrived:
            one = snapshots.index_entries(kept.filter(F.col("snapshot_id") == row.snapshot_id), profile)
            monitor.run_scan(one.select("entity_id", "doc"), root, row.snapshot_id, row.created_at, row.created_at, profile=profile)
        kept.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
