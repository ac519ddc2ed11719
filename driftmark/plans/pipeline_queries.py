"""The whole chain over the document versions: scans into a snapshot store, built events, the stored events' feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import events as E
from driftmark.operators import feed as B
from driftmark.plans import monitor
from driftmark.plans.registry import query
from driftmark.plans.snapshot_queries import EVENTS_SQL
from driftmark.plans.versions_of_tables import document_versions
from driftmark.session import new_work_dir
from driftmark.sources import event_store

#: Prices differ by amount for every thirteenth document and by currency alone for every seventeenth.
PRICED_SQL = EVENTS_SQL + """,
pe AS (SELECT doc_id, change_type, field, CASE field WHEN '<entry>' THEN NULL ELSE before END AS before, CASE field WHEN '<entry>' THEN NULL ELSE after END AS after FROM ev
       UNION ALL SELECT doc_id, 'price_change', 'pricing_information', NULL, NULL FROM p WHERE doc_id % 13 = 0 OR doc_id % 17 = 0)"""
TIMES = ["2026-06-30T08:00:00+00:00", "2026-07-01T08:00:00+00:00", "2026-07-02T08:00:00+00:00"]


def _documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """`(entity_id, doc VARIANT)` of both versions, with a nested price list."""
    found = []
    for version, df in enumerate(document_versions(spark, folder)):
        dearer, moved = (F.col("doc_id") % 13 == 0) & F.lit(version == 1), (F.col("doc_id") % 17 == 0) & F.lit(version == 1)
        price = F.struct(F.when(dearer, "15").otherwise("12").alias("value"), F.when(moved, "USD").otherwise("EUR").alias("currency"))
        doc = F.struct(
            F.col("doc_id").cast("string").alias("id"), F.col("source").alias("status"), F.col("text").alias("description"),
            F.col("lang").alias("manufacturer"), F.array(price).alias("pricing_information"),
        )
        found.append(df.select(F.col("doc_id").cast("string").alias("entity_id"), F.to_variant_object(doc).alias("doc")))
    return found[0], found[1]


@query(
    "built_change_events",
    f"""WITH {PRICED_SQL} SELECT CAST(doc_id AS VARCHAR) AS entity_id, change_type, field, before, after,
CASE change_type WHEN 'price_change' THEN true END AS price_visible FROM pe""",
)
def built_change_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events built from two versions of nested documents; price events carry their verdict."""
    before, after = _documents(spark, folder)
    pairs = before.withColumnRenamed("doc", "before").join(after.withColumnRenamed("doc", "after"), "entity_id", "full_outer")
    events = E.build_change_events(pairs, TIMES[0], TIMES[1], TIMES[1])
    return events.select(
        "entity_id", "change_type", "field", V.as_text(F.col("before")).alias("before"), V.as_text(F.col("after")).alias("after"), "price_visible"
    )


def _scanned(spark: SparkSession, folder: str, digest: monitor.Digest | None = None) -> str:
    """Three scans, the third of the first version again; the folder of the store."""
    root = new_work_dir(spark, "scans")
    before, after = _documents(spark, folder)
    for at, entries in zip(TIMES, (before, after, before)):
        monitor.run_scan(entries, root, at[:10].replace("-", ""), at, at, digest=digest)
    return root


@query(
    "scans_of_three_versions",
    f"""WITH {PRICED_SQL}, n AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM pe) AS ne)
SELECT '20260630' AS batch_id, nb AS number_of_entities, 0 AS changes_detected FROM n UNION ALL SELECT '20260701', na, ne FROM n UNION ALL SELECT '20260702', nb, ne FROM n""",
)
def scans_of_three_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The scan history after three scans into one store."""
    return monitor.scan_history(spark, _scanned(spark, folder)).select("batch_id", "number_of_entities", "changes_detected")


@query(
    "stored_events_feed",
    f"""WITH {PRICED_SQL} SELECT CAST(doc_id AS VARCHAR) AS entity_key, DATE '2026-07-01' AS local_date, count(*) AS adjustments FROM pe GROUP BY doc_id
UNION ALL SELECT CAST(doc_id AS VARCHAR), DATE '2026-07-02', count(*) FROM pe GROUP BY doc_id""",
)
def stored_events_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Feed groups of the events that the scans stored, price events among them."""
    events = E.in_sequence(event_store.read_events(spark, _scanned(spark, folder)))
    groups = B.feed_groups(events.filter(B.is_real(events)))
    return groups.select("entity_key", "local_date", "adjustments")


@query(
    "scan_digest_log",
    f"""WITH {PRICED_SQL}, n AS (SELECT count(*) AS ne FROM pe)
SELECT '20260630' AS batch_id, 0 AS number_of_changes, '0 Änderung(en) erkannt' AS subject, 'skipped' AS status FROM n
UNION ALL SELECT day, ne, ne || ' Änderung(en) erkannt', 'sent' FROM n, (VALUES ('20260701'), ('20260702')) d(day)""",
)
def scan_digest_log(spark: SparkSession, folder: str) -> DataFrame:
    """The digest log of three scans: nothing to tell of the first, delivered for the others."""
    sent = monitor.Digest("team@example.org", lambda numbers, lines: lines.write.format("noop").mode("overwrite").save())
    return monitor.digest_log(spark, _scanned(spark, folder, sent)).select("batch_id", "number_of_changes", "subject", "status")
