"""Versions in time: consecutive pairs, latest versions, nearest version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.skew import OrderedKeys, lookup_join
from driftmark.session import new_work_dir


def consecutive_versions(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], **skew) -> DataFrame:
    """Every row with the preceding version of its entity in struct `previous` (null for the first)."""
    return OrderedKeys(df, [entity], order, **skew).lag(columns, "previous")


def snapshot_pairs(snapshots: DataFrame, **skew) -> DataFrame:
    """`(previous_id, snapshot_id)` over the dimension of snapshots: one row per scan, never per entity."""
    one = snapshots.select("snapshot_id", F.lit(0).alias("__all"))
    paired = OrderedKeys(one, ["__all"], ["snapshot_id"], **skew).lag(["snapshot_id"], "previous")
    return paired.select(F.col("previous.snapshot_id").alias("previous_id"), "snapshot_id")


def latest_snapshots(snapshots: DataFrame, limit: int = 2) -> DataFrame:
    """The last `limit` snapshots by id: each task keeps `limit` rows, nothing else moves."""
    return snapshots.orderBy(F.desc("snapshot_id")).limit(limit)


def marks_around(times: DataFrame, marks: DataFrame) -> DataFrame:
    """`(t, earlier, later)` of distinct times `(t)`: the last mark `(t, id)` at or before each and the first at or after it.

    A prefix scan: times and marks are laid out in one order over range partitions, each of which fills in its own
    marks; what reaches over a border is carried along one row per partition. No time meets more than two marks.
    """
    mark = F.struct("t", "id")
    laid = times.select("t", F.lit(None).cast("struct<t:bigint,id:string>").alias("mark"), F.lit(True).alias("asked")).unionByName(
        marks.select("t", mark.alias("mark"), F.lit(False).alias("asked"))
    )
    # Stored with its partition's number, so that both readers see one and the same partitioning.
    folder = new_work_dir(times.sparkSession, "marks-around")
    laid.repartitionByRange("t").withColumn("part", F.spark_partition_id()).write.parquet(folder)
    placed = times.sparkSession.read.schema("t bigint, mark struct<t:bigint,id:string>, asked boolean, part int").parquet(folder)
    ends = placed.groupBy("part").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    by_part = Window.orderBy("part")  # a row per partition
    carried = ends.select(
        "part",
        F.last("last", True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", True).over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    own = Window.partitionBy("part").orderBy("t")
    scanned = placed.select(
        "part", "t", "asked", F.last("mark", True).over(own).alias("earlier"),
        # From the far end, so that one pass with a growing frame does.
        F.last("mark", True).over(Window.partitionBy("part").orderBy(F.desc("t"))).alias("later"),
    )
    found = scanned.filter("asked").join(F.broadcast(carried), "part", "left")
    return found.select("t", F.coalesce("earlier", "before").alias("earlier"), F.coalesce("later", "after").alias("later"))


def nearest_version(events: DataFrame, ts: str, marks: DataFrame, mark_ts: str, mark_id: str, **skew) -> DataFrame:
    """As-of join to the mark with the smallest absolute distance; on a tie the earlier mark, of marks of one time the least id.

    The nearest mark depends on the time alone, so distinct times are looked up, and events of a time that very many share
    are spread. Events without a time, and all events if there is no mark, get null.
    """
    kind = dict(marks.dtypes)[mark_id]
    points = marks.groupBy(F.unix_micros(F.col(mark_ts).cast("timestamp")).alias("t")).agg(F.min(mark_id).cast("string").alias("id")).filter("t is not null")
    timed = events.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    times = timed.select(F.col("__t").alias("t")).filter("t is not null").distinct()
    around = marks_around(times, points)
    closer = F.col("later").isNull() | (F.col("t") - F.col("earlier.t") <= F.col("later.t") - F.col("t"))
    chosen = F.when(F.col("earlier").isNotNull() & closer, F.col("earlier.id")).otherwise(F.col("later.id"))
    looked_up = around.select(F.col("t").alias("__t"), chosen.cast(kind).alias(mark_id))
    return lookup_join(timed, looked_up, ["__t"], "left", salt_by=events.columns, **skew).drop("__t")


def distance_seconds(left: Column, right: Column) -> Column:
    return F.abs(F.unix_micros(left.cast("timestamp")) - F.unix_micros(right.cast("timestamp"))) / 1e6
