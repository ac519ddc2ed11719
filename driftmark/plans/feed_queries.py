"""Version histories, the change feed and the digest over the user events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import times as D
from driftmark.operators import digest as N
from driftmark.operators import feed as B
from driftmark.operators import versions as G
from driftmark.plans.registry import query, table
from driftmark.plans.versions_of_tables import USER_EVENTS_SQL, VERSION_COLUMNS, user_events, user_versions
from driftmark.session import new_work_dir
from driftmark.streaming import change_feed

TRANSITIONS_SQL = """
SELECT event_id, user_id, event_type, value, previous_type, previous_value FROM (
  SELECT event_id, user_id, event_type, value, lag(event_type) OVER w AS previous_type, lag(value) OVER w AS previous_value,
         lag(event_id) OVER w AS previous_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE previous_id IS NOT NULL"""


def _transition_columns(rows: DataFrame) -> DataFrame:
    return rows.filter("previous is not null").select(
        "event_id", "user_id", "event_type", "value", F.col("previous.event_type").alias("previous_type"), F.col("previous.value").alias("previous_value")
    )


@query("version_transitions", TRANSITIONS_SQL)
def version_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return _transition_columns(user_versions(spark, folder))


def _fed(spark: SparkSession, folder: str, slices: int = 4, bucket_rows: int = 200) -> str:
    """The events arrive in slices of time, a micro-batch each; the folder the feed wrote to."""
    root = new_work_dir(spark, "stream")
    events = table(spark, folder, "events").select("user_id", *VERSION_COLUMNS)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(at.alias("t")).approxQuantile("t", [i / slices for i in range(1, slices)], 0.01)
    files = 2  # of a slice, and so of a micro-batch
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        events.filter(inside).repartition(files, "user_id").write.mode("append").parquet(f"{root}/arrived")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/arrived")
    running = change_feed.start_change_feed(
        stream, root, f"{root}/checkpoint", "user_id", ["ts", "event_id"], VERSION_COLUMNS, bucket_rows=bucket_rows
    )
    running.awaitTermination()
    return root


@query("stream_change_feed", TRANSITIONS_SQL)
def stream_change_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The same transitions, computed by the streaming feed over rows that arrive in four micro-batches."""
    return _transition_columns(change_feed.read_transitions(spark, _fed(spark, folder)))


@query(
    "stream_last_versions",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id",
)
def stream_last_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The feed's keyed state after its last micro-batch."""
    root, kinds = _fed(spark, folder), dict(table(spark, folder, "events").dtypes)
    columns = ", ".join(f"{c}:{kinds[c]}" for c in VERSION_COLUMNS)
    known = change_feed.last_known(spark, root, "user_id", kinds["user_id"], columns)
    return known.select("user_id", "version.event_id", "version.ts")


def _daily_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One snapshot per day of events: `(snapshot_id, taken_at, entry_count)`."""
    day = F.date_trunc("day", "ts")
    counted = table(spark, folder, "events").groupBy(day.alias("taken_at")).agg(F.count(F.lit(1)).alias("entry_count"))
    return counted.select(F.date_format("taken_at", "yyyyMMdd").alias("snapshot_id"), "taken_at", "entry_count")


@query(
    "latest_two_versions",
    "SELECT strftime(ts, '%Y%m%d') AS snapshot_id, count(*) AS entry_count FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 2",
)
def latest_two_versions(spark: SparkSession, folder: str) -> DataFrame:
    return G.latest_snapshots(_daily_snapshots(spark, folder), 2).select("snapshot_id", "entry_count")


@query(
    "snapshot_pairs",
    "SELECT lag(s) OVER (ORDER BY s) AS previous_id, s AS snapshot_id FROM (SELECT DISTINCT strftime(ts, '%Y%m%d') AS s FROM events)",
)
def snapshot_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return G.snapshot_pairs(_daily_snapshots(spark, folder))


@query(
    "nearest_snapshot_join",
    """WITH m AS (SELECT DISTINCT date_trunc('day', ts) AS mark FROM events)
SELECT event_id, user_id, strftime(arg_min(mark, (abs(epoch_us(ts) - epoch_us(mark)), mark)), '%Y%m%d') AS snapshot_id
FROM events, m GROUP BY event_id, user_id""",
)
def nearest_snapshot_join(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    marks = _daily_snapshots(spark, folder)
    return G.nearest_version(events, "ts", marks, "taken_at", "snapshot_id").select("event_id", "user_id", "snapshot_id")


META = """(field IN ('source_update_notice', 'source_update_notice.checked_sources', 'source_update_notice.last_updated_at', 'source_update_notice.notice_text'))"""
INTERNAL = "(simulated OR development OR (before IS NULL AND field = 'source_update_notice'))"
REAL_SQL = USER_EVENTS_SQL + f""",
real AS (SELECT *, lower(entity_id) AS entity_key, CAST(ts + INTERVAL 1 HOUR AS DATE) AS local_date FROM e WHERE NOT {META} AND NOT {INTERNAL}),
scored AS (SELECT *, CASE field WHEN 'descriptive_texts.activity' THEN 30 WHEN 'evidence_summary_text' THEN 5 ELSE 0 END AS score,
                  CASE field WHEN 'status' THEN 'Aufnahmestatus' WHEN 'pricing_information' THEN 'Vergütung / Preisangaben'
                             WHEN 'descriptive_texts.activity' THEN 'Beschreibung der DiGA' ELSE 'Bewertungsentscheidung des BfArM' END AS label,
                  CASE change_type WHEN 'text_change' THEN 'text_change' ELSE field END AS s1,
                  CASE change_type WHEN 'text_change' THEN lower(before) || ' ' || lower(after) ELSE coalesce(before, 'None') END AS s2,
                  CASE change_type WHEN 'text_change' THEN '' ELSE coalesce(after, 'None') END AS s3 FROM real),
rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, local_date, s1, s2, s3 ORDER BY score DESC, seq) AS rn FROM scored) WHERE rn = 1)"""


@query("real_events", f"WITH {REAL_SQL} SELECT seq, entity_id, field, change_type FROM real")
def real_events(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return events.filter(B.is_real(events)).select("seq", "entity_id", "field", "change_type")


@query("notifiable_events", f"WITH {USER_EVENTS_SQL} SELECT seq, entity_id, field, change_type FROM e WHERE NOT {INTERNAL}")
def notifiable_events(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return events.filter(B.is_notifiable(events)).select("seq", "entity_id", "field", "change_type")


@query(
    "metadata_events",
    f"WITH {USER_EVENTS_SQL} SELECT field, {META} AS metadata, count(*) AS events FROM e GROUP BY ALL",
)
def metadata_events(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return events.select("field", B.is_metadata(events).alias("metadata")).groupBy("field", "metadata").agg(F.count(F.lit(1)).alias("events"))


@query(
    "local_date_range",
    f"""WITH {USER_EVENTS_SQL} SELECT seq, CAST(ts + INTERVAL 1 HOUR AS DATE) AS local_date FROM e
WHERE CAST(ts + INTERVAL 1 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def local_date_range(spark: SparkSession, folder: str) -> DataFrame:
    events = B.in_local_dates(user_events(spark, folder), "2024-01-05", "2024-01-20")
    return events.select("seq", D.local_date(D.parse_time(F.col("detected_at"))).alias("local_date"))


@query("feed_dedupe", f"WITH {REAL_SQL} SELECT entity_key, local_date, seq, field, change_type, before, after, label, score FROM rows")
def feed_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    rows = B.feed_events(events.filter(B.is_real(events)))
    return rows.select("entity_key", "local_date", "seq", "field", "change_type", "before", "after", "label", "score")


GROUPS_SQL = REAL_SQL + """,
groups AS (SELECT entity_key, local_date, arg_max(entity_name, (detected_at, label, -seq)) AS entity_name,
                  arg_max(manufacturer, (detected_at, label, -seq)) FILTER (WHERE manufacturer <> '') AS manufacturer,
                  arg_max(entity_url, (detected_at, label, -seq)) FILTER (WHERE entity_url <> '') AS entity_url,
                  max(detected_at) AS detected_at, min(previous_snapshot_ts) AS previous_snapshot_ts, max(current_snapshot_ts) AS current_snapshot_ts,
                  count(*) AS adjustments FROM rows GROUP BY entity_key, local_date)"""


@query("feed_groups", f"WITH {GROUPS_SQL} SELECT *, CAST(NULL AS VARCHAR) AS source_update_notice FROM groups")
def feed_groups(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return B.in_feed_order(B.feed_groups(events.filter(B.is_real(events))))


@query(
    "feed_totals",
    f"WITH {GROUPS_SQL} SELECT count(*) AS affected_entities, CAST(sum(adjustments) AS BIGINT) AS adjustments, max(CAST(left(detected_at, 26) AS TIMESTAMP)) AS latest_change FROM groups",
)
def feed_totals(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return B.feed_totals(B.feed_groups(events.filter(B.is_real(events))))


@query(
    "digest_numbers",
    f"""WITH {USER_EVENTS_SQL} SELECT count(*) AS number_of_changes, min(CAST(left(previous_snapshot_ts, 26) AS TIMESTAMP)) AS previous_state,
max(CAST(left(current_snapshot_ts, 26) AS TIMESTAMP)) AS current_state, count(*) || ' Änderung(en) erkannt' AS subject FROM e WHERE NOT {INTERNAL}""",
)
def digest_numbers(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return N.digest_numbers(events.filter(B.is_notifiable(events)))


@query(
    "digest_top10",
    f"""WITH {USER_EVENTS_SQL} SELECT seq, entity_name,
  CASE change_type WHEN 'status_change' THEN 'Statusänderung' WHEN 'price_change' THEN 'Preisänderung' WHEN 'text_change' THEN 'Textänderung' ELSE 'Sonstige Feldänderung' END AS change_label,
  CASE field WHEN 'status' THEN 'Aufnahmestatus' WHEN 'pricing_information' THEN 'Vergütung / Preisangaben' WHEN 'descriptive_texts.activity' THEN 'Beschreibung der DiGA'
             WHEN 'source_update_notice' THEN 'Aktualisierungshinweis im DiGA-Verzeichnis' ELSE 'Bewertungsentscheidung des BfArM' END AS area,
  CASE change_type WHEN 'status_change' THEN 'Der Aufnahmestatus wurde geändert.' WHEN 'price_change' THEN 'Preisangaben wurden geändert.'
                   WHEN 'text_change' THEN 'Text wurde geändert.' ELSE 'Ein Feld wurde geändert.' END AS description,
  CASE WHEN change_type = 'text_change' THEN before END AS removed_phrase, CASE WHEN change_type = 'text_change' THEN after END AS added_phrase
FROM e WHERE NOT {INTERNAL} ORDER BY seq LIMIT 10""",
)
def digest_top10(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return N.digest_lines(events.filter(B.is_notifiable(events)), 10)


@query(
    "changed_targets",
    f"""WITH {USER_EVENTS_SQL}, n AS (SELECT * FROM e WHERE NOT {INTERNAL}),
k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN user_id % 2 = 0 THEN 'https://entries.example/' || user_id END AS url FROM events),
t AS (SELECT n.entity_id, n.entity_name, coalesce(n.entity_url, k.url) AS entity_url, n.seq FROM n JOIN k USING (entity_id))
SELECT entity_id, arg_max(entity_name, seq) AS entity_name, arg_max(entity_url, seq) AS entity_url FROM t WHERE entity_url IS NOT NULL GROUP BY entity_id""",
)
def changed_targets(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    entries = table(spark, folder, "events").select("user_id").distinct().select(
        user.alias("entity_id"), F.concat(F.lit("Entry "), user).alias("entity_name"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("https://entries.example/"), user)).alias("entity_url"),
    )
    return B.changed_targets(user_events(spark, folder), entries)


@query(
    "entity_key_match",
    """WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k1, upper('Customer#' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0')) AS k2 FROM orders),
keys AS (SELECT o_orderkey, lower(k1) AS key FROM o UNION SELECT o_orderkey, lower(k2) FROM o),
owners AS (SELECT key, min(c_custkey) AS c_custkey FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey FROM customer UNION ALL SELECT lower(c_name), c_custkey FROM customer) GROUP BY key)
SELECT o_orderkey, min(c_custkey) AS c_custkey FROM keys LEFT JOIN owners USING (key) GROUP BY o_orderkey""",
)
def entity_key_match(spark: SparkSession, folder: str) -> DataFrame:
    """Orders carry a customer number and, in other case, the name of the next customer: the first entry wins."""
    shifted = F.lpad((F.col("o_custkey") + 1).cast("string"), 9, "0")
    events = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("k1"), F.upper(F.concat(F.lit("Customer#"), shifted)).alias("k2")
    )
    entries = table(spark, folder, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("position"))
    return B.match_entities(events, "o_orderkey", ["k1", "k2"], entries, "c_custkey", ["c_custkey", "c_name"], "position")


@query(
    "scalar_times",
    """SELECT event_id, ts AS parsed, CAST(ts + INTERVAL 1 HOUR AS DATE) AS local_date, strftime(ts + INTERVAL 1 HOUR, '%d.%m.%Y %H:%M') AS shown,
  strftime(ts, '%Y-%m-%d') AS sort_key, strftime(ts, '%d.%m.%Y') AS shown_date,
  'Zuletzt aktualisiert am ' || strftime(ts + INTERVAL 1 HOUR, '%d.%m.%Y') || ' um ' || strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS notice,
  'gültig ab ' || strftime(ts, '%d.%m.%Y') AS valid, strftime(ts, '%Y%m%dT%H%M%S') || strftime(ts, '%f') AS batch, ts AS from_name FROM events""",
)
def scalar_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
        F.concat(F.lit("snapshot_"), F.date_format("ts", "yyyyMMdd'T'HHmmssSSSSSS'Z'"), F.lit(".json")).alias("name"),
    )
    iso = F.col("iso")
    parsed = D.parse_time(iso)
    return rows.select(
        "event_id", parsed.alias("parsed"), D.local_date(parsed).alias("local_date"), D.format_time_text(iso).alias("shown"),
        D.date_sort_key(iso).alias("sort_key"), D.format_date(iso).alias("shown_date"), D.update_notice(iso).alias("notice"),
        D.validity(D.format_date(iso), F.lit(None).cast("string")).alias("valid"), D.compact_timestamp(iso).alias("batch"),
        D.snapshot_time(F.col("name")).alias("from_name"),
    )
