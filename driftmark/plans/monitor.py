"""One monitor scan: store the snapshot, diff it with its predecessor, append events and history."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.operators import digest as N
from driftmark.operators import entity_diff as C
from driftmark.operators import events as E
from driftmark.operators import feed as B
from driftmark.operators import history as H
from driftmark.operators import versions as G
from driftmark.presets import DEFAULT, Profile
from driftmark.sources import event_store, logs, snapshots

HISTORY_LOG, DIGEST_LOG = "scan_history", "digest_log"
# Rows of a changed-key set that may be broadcast; each is one id of a few dozen bytes.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Digest:
    """Who is told of a scan's changes, and how: `deliver(numbers row, lines)`; without it a digest is logged, not sent."""

    recipient: str = ""
    deliver: Callable[[Row, DataFrame], None] | None = None
    include_simulated: bool = False


@dataclass(frozen=True)
class Scan:
    """What one run did."""

    snapshot_id: str
    previous_id: str | None
    entities: int
    events: int
    mode: str


def pairs_to_compare(spark: SparkSession, root: str, previous_id: str, snapshot_id: str) -> DataFrame:
    """`(entity_id, before, after)` of everything that is not equal on both sides.

    The fingerprints decide first: a join of ids and hashes only.  Its result is written, its size
    is therefore known, and documents are fetched for those ids alone, by broadcast when the ids
    are few and by a shuffle join when they are many.
    """
    before = snapshots.read_snapshot(spark, root, previous_id)
    after = snapshots.read_snapshot(spark, root, snapshot_id)
    kinds = C.classify_entities(before, after, "entity_id").filter(F.col("kind") != C.UNCHANGED)
    path = f"{root}/differences/snapshot_id={snapshot_id}"
    kinds.select("entity_id").write.mode("overwrite").parquet(path)
    differing = spark.read.parquet(path)
    if differing.count() <= BROADCAST_KEYS:
        differing = F.broadcast(differing)
    old = before.join(differing, "entity_id", "left_semi").select("entity_id", F.col("doc").alias("before"))
    new = after.join(differing, "entity_id", "left_semi").select("entity_id", F.col("doc").alias("after"))
    return old.join(new, "entity_id", "full_outer")


def diff_latest(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """Ids of the two latest snapshots, oldest first, or None when there are fewer than two."""
    newest = G.latest_snapshots(snapshots.list_snapshots(spark, root), 2).select("snapshot_id").take(2)
    return (newest[1][0], newest[0][0]) if len(newest) == 2 else None


def tell_changes(spark: SparkSession, root: str, snapshot_id: str, found: int, detected_at: str, digest: Digest) -> None:
    """Deliver the digest of a scan's notifiable events and log what became of it, under the scan's id.

    Without such events nothing is delivered. A delivery that fails is logged and doesn't fail the scan, whose results
    are stored by then.
    """
    if found:
        events = event_store.read_batch(spark, root, snapshot_id)
        notable = E.in_sequence(events.filter(B.is_notifiable(events, digest.include_simulated)))
        numbers = N.digest_numbers(notable)
    else:
        numbers = spark.range(1).select(F.lit(0).cast("bigint").alias("number_of_changes"), F.lit(presets.DIGEST_SUBJECT % 0).alias("subject"))
    row = numbers.first()
    status, error = "skipped", presets.DIGEST_NO_CHANGES
    if row.number_of_changes:
        error = presets.DIGEST_NOT_SENT
        if digest.deliver:
            status, error = "sent", None
            try:
                digest.deliver(row, N.digest_lines(notable))
            except Exception as failure:  # whatever the mail system throws
                status, error = "failed", str(failure)
    logged = spark.createDataFrame([(row.number_of_changes, row.subject)], "number_of_changes bigint, subject string")
    logs.append_log(N.digest_log_row(logged, detected_at, status, digest.recipient, error), root, DIGEST_LOG, snapshot_id)


def run_scan(
    entries: DataFrame,
    root: str,
    snapshot_id: str,
    created_at: str,
    detected_at: str,
    mode: str = "full",
    profile: Profile = DEFAULT,
    digest: Digest | None = None,
) -> Scan:
    """Run one scan over `(entity_id, doc VARIANT)`.

    The first scan is the baseline: no events, one history row.  `mode="sample"` stores and logs a
    partial scan, and never produces events. With a `digest` the scan tells of its changes and logs that.
    """
    spark, started = entries.sparkSession, time.monotonic()
    earlier = snapshots.list_snapshots(spark, root).filter(F.col("snapshot_id") < snapshot_id)
    previous = G.latest_snapshots(earlier, 1).take(1)
    count = snapshots.write_snapshot(entries, root, snapshot_id, created_at)
    found = 0
    if previous and mode != "sample":
        pairs = pairs_to_compare(spark, root, previous[0]["snapshot_id"], snapshot_id)
        events = E.build_change_events(pairs, previous[0]["created_at"], created_at, detected_at, profile)
        found = event_store.append_events(events, root, snapshot_id)
    numbers = spark.range(1).select(F.lit(count).alias("number_of_entities"), F.lit(found).alias("changes_detected"))
    row = H.history_row(numbers, detected_at, time.monotonic() - started)
    logs.append_log(row, root, HISTORY_LOG, snapshot_id)
    if digest:
        tell_changes(spark, root, snapshot_id, found, detected_at, digest)
    return Scan(snapshot_id, previous[0]["snapshot_id"] if previous else None, count, found, mode)


def scan_history(spark: SparkSession, root: str) -> DataFrame:
    return logs.read_log(spark, root, HISTORY_LOG, logs.HISTORY)


def digest_log(spark: SparkSession, root: str) -> DataFrame:
    return logs.read_log(spark, root, DIGEST_LOG, logs.DIGESTS)
