"""Prices, record assembly, page sections and scan history over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators import assembly as A
from driftmark.operators import events as E
from driftmark.operators import feed as B
from driftmark.operators import history as H
from driftmark.operators import identity as I
from driftmark.operators import prices as P
from driftmark.operators import sections as S
from driftmark.operators.skew import dealt, lookup_join
from driftmark.plans import monitor
from driftmark.plans.registry import query, table
from driftmark.plans.versions_of_tables import (
    BLOCKS_SQL,
    PRICE_LINE,
    PRICES_SQL,
    USER_EVENTS_SQL,
    block_sections,
    page_versions,
    price_versions,
    user_events,
)
from driftmark.session import new_work_dir
from driftmark.sources import logs
from driftmark.sources.sitemap import directory_urls

# ---- prices --------------------------------------------------------------------------------------------


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    before, after = price_versions(spark, folder)
    return P.compare_price_lines(before, after, "part", PRICE_LINE, "position")


@query(
    "price_verdicts",
    f"WITH {PRICES_SQL} SELECT part, lines_before, lines_after, verdict, verdict <> 'order' AS visible FROM verdicts",
)
def price_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder)


@query(
    "price_semantic_changes",
    f"""WITH {PRICES_SQL} SELECT part, CASE verdict WHEN 'amount' THEN 'Preiswert geändert' ELSE 'Preiszeitraum aktualisiert' END AS title
FROM verdicts WHERE verdict <> 'order'""",
)
def price_semantic_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).filter("visible").select("part", P.verdict_title(F.col("verdict")).alias("title"))


# ---- assembly ------------------------------------------------------------------------------------------

RECORDS_SQL = """
m AS (SELECT l_orderkey, count(*) AS modules, CAST(sum(l_quantity) AS BIGINT) AS units, max(l_shipdate) AS last_module FROM lineitem GROUP BY l_orderkey),
rec AS (SELECT o_orderkey AS entity_id, c_name AS name, n_name AS manufacturer,
               CASE WHEN o_orderstatus = 'F' THEN 'listed' WHEN o_orderstatus = 'P' THEN 'provisional' WHEN starts_with(o_orderpriority, '5') THEN 'removed' ELSE 'listed' END AS status,
               coalesce(modules, 0) AS modules, coalesce(units, 0) AS units, last_module
        FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN m ON l_orderkey = o_orderkey)"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog entries (orders) with their app (customer), manufacturer (nation) and modules (lineitem)."""
    words = F.create_map(F.lit("F"), F.lit(" Permanent"), F.lit("P"), F.lit(" provisional"))
    catalog = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"),
        F.concat("o_orderpriority", F.coalesce(F.try_element_at(words, F.col("o_orderstatus")), F.lit(""))).alias("wording"),
        F.when(F.startswith("o_orderpriority", F.lit("5")), F.col("o_orderdate").cast("string")).alias("ended"),
    )
    apps = table(spark, folder, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("pos"))
    matched = A.join_first_match(catalog, apps, "c_custkey", "pos", salt_by=["o_orderkey"])
    makers = table(spark, folder, "nation").select("n_nationkey", "n_name")
    owned = lookup_join(matched, makers, ["n_nationkey"], "left", salt_by=["o_orderkey"])
    modules = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("modules"), F.sum("l_quantity").cast("bigint").alias("units"), F.max("l_shipdate").alias("last_module")
    )
    full = owned.join(modules, "o_orderkey", "left")
    zero = F.lit(0).cast("bigint")
    return full.select(
        F.col("o_orderkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("n_name").alias("manufacturer"),
        A.infer_status(F.col("wording"), F.col("ended")).alias("status"), F.coalesce("modules", zero).alias("modules"),
        F.coalesce("units", zero).alias("units"), "last_module",
    )


@query("assembled_records", f"WITH {RECORDS_SQL} SELECT * FROM rec")
def assembled_records(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder)


@query("record_status_counts", f"WITH {RECORDS_SQL} SELECT manufacturer, status, count(*) AS records FROM rec GROUP BY ALL")
def record_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).groupBy("manufacturer", "status").agg(F.count(F.lit(1)).alias("records"))


@query(
    "units_by_manufacturer",
    """SELECT s_nationkey, count(*) AS units, count(DISTINCT l_partkey) AS distinct_units
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) u JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey""",
)
def units_by_manufacturer(spark: SparkSession, folder: str) -> DataFrame:
    """Units (parts) through the modules (suppliers) they refer to: twice on two modules of one parent."""
    refs = table(spark, folder, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    modules = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    rows = A.units_by_parent(modules, refs, "s_nationkey", "s_suppkey")
    per_part = rows.groupBy("s_nationkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return per_part.groupBy("s_nationkey").agg(F.sum("n").alias("units"), F.count(F.lit(1)).alias("distinct_units"))


@query(
    "responses_per_record",
    """SELECT doc_id, count(conv_id) AS responses, max(turn) AS last_turn, coalesce(arg_max(role, turn), 'none') AS last_role
FROM documents LEFT JOIN conversations ON conv_id = doc_id GROUP BY doc_id""",
)
def responses_per_record(spark: SparkSession, folder: str) -> DataFrame:
    """Responses (conversation turns) of every record (document), reduced before the join."""
    answers = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("responses"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role")
    )
    joined = table(spark, folder, "documents").select("doc_id").join(answers, "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("responses", F.lit(0).cast("bigint")).alias("responses"), "last_turn", F.coalesce("last_role", F.lit("none")).alias("last_role")
    )


@query(
    "question_labels",
    """SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS label FROM lineitem LEFT JOIN
(SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS p_name FROM part) ON p_partkey = l_partkey""",
)
def question_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Answers (lineitems) under their question text (part name), the link id where there is none."""
    labels = table(spark, folder, "part").select(
        F.lit("q").alias("url"), F.col("p_partkey").cast("string").alias("link_id"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("label")
    )
    answers = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.lit("q").alias("questionnaire"), F.col("l_partkey").cast("string").alias("link_id")
    )
    return A.labelled_answers(answers, labels).select("l_orderkey", "l_linenumber", "l_suppkey", "label")


@query(
    "records_backfilled",
    """SELECT o_orderkey AS entity_id, coalesce(status, 'unknown') AS status, modules FROM orders LEFT JOIN
(SELECT l_orderkey, 'listed' AS status, count(*) AS modules FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def records_backfilled(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("entity_id"))
    parts = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("entity_id"))
    lines = dealt(parts, ["entity_id"], parts.count()).groupBy("entity_id").agg(F.count(F.lit(1)).alias("modules"))
    records = lines.join(orders, "entity_id", "left_semi").withColumn("status", F.lit("listed"))
    return A.backfill(records, orders, "entity_id", {"status": F.lit("unknown")}).select("entity_id", "status", "modules")


@query(
    "latest_source_update",
    """WITH c AS (SELECT o_orderkey AS entity_id, 'catalog_entry' AS source, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t FROM orders
UNION ALL SELECT l_orderkey, 'module.' || l_linenumber, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') FROM lineitem)
SELECT entity_id, max(t) AS last_updated_at, count(*) AS checked_sources FROM c WHERE t <> '' GROUP BY entity_id""",
)
def latest_source_update(spark: SparkSession, folder: str) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_updated")
    candidates = A.source_updates(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("entity_id"), F.lit("catalog_entry").alias("source"), iso("o_orderdate")),
        table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("entity_id"), F.concat(F.lit("module."), F.col("l_linenumber").cast("string")).alias("source"), iso("l_shipdate")
        ),
    )
    return A.latest_update(candidates, by="time")


@query(
    "record_dedupe",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER
(PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def record_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    kept = I.latest_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return kept.drop("l_shipdate")


URL_PATTERN = r"^https?://[^/]+/[a-z]{2}/[0-9]+$"


@query(
    "directory_urls",
    rf"""SELECT DISTINCT regexp_extract(url, '[^/]+$') AS entity_id, url AS entity_url FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url FROM pages)
WHERE regexp_matches(url, '{URL_PATTERN}')""",
)
def page_directory_urls(spark: SparkSession, folder: str) -> DataFrame:
    return directory_urls(table(spark, folder, "pages"), F.regexp_replace("url", "[?#].*$", ""), URL_PATTERN)


@query(
    "padded_identifiers",
    "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS entity_id FROM customer",
)
def padded_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers read from documents by their system, padded and never cut."""
    item = F.struct(
        F.concat(F.lit("https://ids.example/Number"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise("")).alias("system"),
        F.col("c_custkey").alias("value"),
    )
    other = F.struct(F.lit("https://ids.example/Other").alias("system"), F.lit(-1).cast("bigint").alias("value"))
    docs = table(spark, folder, "customer").select("c_custkey", F.to_variant_object(F.struct(F.array(other, item).alias("identifier"))).alias("doc"))
    return docs.select("c_custkey", A.identifier_value(F.col("doc"), "Number", 3).alias("entity_id"))


# ---- sections --------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    before, after = page_versions(spark, folder)
    return block_sections(before), block_sections(after)


def _section_changes(spark: SparkSession, folder: str) -> DataFrame:
    before, after = _sides(spark, folder)
    return S.section_changes(S.diffable_sections(before, "page_id"), S.diffable_sections(after, "page_id"), "page_id")


SECTION_DIFF_SQL = BLOCKS_SQL + """,
cb AS (SELECT page_id, stable_key, content, count(*) AS n, min(content_type) AS ct, min(display_path) AS dp FROM sb GROUP BY ALL),
ca AS (SELECT page_id, stable_key, content, count(*) AS n, min(content_type) AS ct, min(display_path) AS dp FROM sa GROUP BY ALL),
j AS (SELECT page_id, stable_key, content, coalesce(cb.n, 0) AS b, coalesce(ca.n, 0) AS a, coalesce(ca.ct, cb.ct) AS ct, coalesce(ca.dp, cb.dp) AS dp
      FROM cb FULL JOIN ca USING (page_id, stable_key, content)),
g AS (SELECT *, b - least(a, b) AS gone, a - least(a, b) AS came,
             sum(CASE WHEN least(a, b) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, stable_key ORDER BY content) AS gap FROM j),
gg AS (SELECT *, sum(gone) OVER gp AS gap_gone, sum(came) OVER gp AS gap_came FROM g WINDOW gp AS (PARTITION BY page_id, stable_key, gap)),
old AS (SELECT page_id, stable_key, gap, gap_gone, gap_came, content, ct, dp, row_number() OVER (PARTITION BY page_id, stable_key, gap ORDER BY content) AS k
        FROM (SELECT *, unnest(range(CAST(gone AS BIGINT))) FROM gg)),
new AS (SELECT page_id, stable_key, gap, gap_gone, gap_came, content, ct, dp, row_number() OVER (PARTITION BY page_id, stable_key, gap ORDER BY content) AS k
        FROM (SELECT *, unnest(range(CAST(came AS BIGINT))) FROM gg)),
changes AS (
  SELECT new.page_id, new.stable_key, CASE new.ct WHEN 'field_value' THEN 'changed_field_value' ELSE 'changed_text' END AS change_type,
         new.ct AS content_type, new.dp AS display_path, old.content AS before, new.content AS after
  FROM old JOIN new USING (page_id, stable_key, gap, k) WHERE old.gap_gone = old.gap_came
  UNION ALL SELECT page_id, stable_key, 'removed_section', ct, dp, content, '' FROM old WHERE gap_gone <> gap_came
  UNION ALL SELECT page_id, stable_key, 'added_section', ct, dp, '', content FROM new WHERE gap_gone <> gap_came),
both_known AS (SELECT DISTINCT page_id FROM sb INTERSECT SELECT DISTINCT page_id FROM sa)"""


@query("section_diff_changes", f"WITH {SECTION_DIFF_SQL} SELECT * FROM changes")
def section_diff_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _section_changes(spark, folder)


def _comparable_changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    before, after = _sides(spark, folder)
    comparable = S.comparable_entities(before, after, "page_id")
    return comparable, _section_changes(spark, folder).join(comparable, "page_id", "left_semi")


@query(
    "section_diff_report",
    f"""WITH {SECTION_DIFF_SQL} SELECT page_id, count(*) AS change_count, string_agg(DISTINCT change_type, ',' ORDER BY change_type) AS change_types
FROM changes WHERE page_id IN (SELECT page_id FROM both_known) GROUP BY page_id""",
)
def section_diff_report(spark: SparkSession, folder: str) -> DataFrame:
    _, changes = _comparable_changes(spark, folder)
    return S.change_report(changes, "page_id")


@query(
    "section_diff_totals",
    f"""WITH {SECTION_DIFF_SQL} SELECT (SELECT count(*) FROM both_known) AS compared_entities, count(DISTINCT page_id) AS entities_with_changes,
count(*) AS total_section_changes FROM changes WHERE page_id IN (SELECT page_id FROM both_known)""",
)
def section_diff_totals(spark: SparkSession, folder: str) -> DataFrame:
    comparable, changes = _comparable_changes(spark, folder)
    return S.report_totals(comparable, changes, "page_id")


@query(
    "section_change_labels",
    f"""WITH {SECTION_DIFF_SQL} SELECT CASE change_type WHEN 'added_section' THEN 'Hinzugefügte Section' WHEN 'removed_section' THEN 'Entfernte Section'
WHEN 'changed_text' THEN 'Geänderter Text' ELSE 'Geändertes Feld/Wert-Paar' END AS label, count(*) AS changes FROM changes GROUP BY 1""",
)
def section_change_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _section_changes(spark, folder)
    return rows.groupBy(E.section_change_label(F.col("change_type")).alias("label")).agg(F.count(F.lit(1)).alias("changes"))


@query("section_excerpts")
def section_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return S.with_excerpts(_section_changes(spark, folder))


@query(
    "section_profile",
    f"""WITH {BLOCKS_SQL} SELECT page_id, CAST(count(*) AS BIGINT) AS content_sections, CAST(count(*) FILTER (WHERE content_type = 'field_value') AS BIGINT) AS field_value_pairs,
count(DISTINCT display_path) AS unique_paths, CAST(0 AS BIGINT) AS fallback_items FROM sa GROUP BY page_id""",
)
def section_profile(spark: SparkSession, folder: str) -> DataFrame:
    _, after = _sides(spark, folder)
    return S.structure_profile(after, "page_id")


@query(
    "section_path_prefixes",
    f"""WITH {BLOCKS_SQL} SELECT page_id, 'Page' AS prefix, 1 AS depth, 'Page' AS label, min(position) AS first_position FROM sa GROUP BY page_id
UNION ALL SELECT page_id, 'Page > ' || tag, 2, tag, min(position) FROM sa GROUP BY page_id, tag""",
)
def section_path_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    _, after = _sides(spark, folder)
    rows = S.path_prefixes(after.withColumn("position", F.col("position").cast("bigint")), "page_id", "position")
    return rows


@query(
    "content_paths",
    """SELECT doc_id, lang = 'en' OR (lang = 'fr' AND source <> 'src0') AS content_path, lang = 'en' OR (lang = 'fr' AND source <> 'src0') AS meaningful FROM documents""",
)
def content_paths(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("lang")
    path = (
        F.when(lang == "en", F.array("lang", "source"))
        .when(lang == "de", F.array(F.lit("Hilfe & Support"), F.col("source")))
        .when((lang == "fr") & (F.col("source") == "src0"), F.array("lang", F.lit("Gebrauchsanweisung (PDF)")))
        .when(lang == "es", F.array(F.lit("WWW.example.org"), F.col("source")))
        .otherwise(F.array("lang", "source"))
    )
    rows = table(spark, folder, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", S.is_content_path(F.col("path")).alias("content_path"), S.is_meaningful_path(F.col("path")).alias("meaningful"))


@query("extract_sections")
def extract_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.extract_sections(table(spark, folder, "pages"), "page_id", "html")
    return rows.select(
        "page_id", "position", F.array_join("path", " > ").alias("display_path"), "level", "title", "content_type", "content", "content_preview", "stable_key"
    )


@query("extracted_section_changes")
def extracted_section_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain: both page versions parsed, then diffed by stable key."""
    before, after = [S.diffable_sections(S.extract_sections(p, "page_id", "html"), "page_id") for p in page_versions(spark, folder)]
    return S.section_changes(before, after, "page_id")


# ---- scan history ---------------------------------------------------------------------------------------------

HISTORY_SQL = """
h AS (SELECT CAST(ts AS DATE) AS scan_date, max(ts) AS scan_timestamp, count(DISTINCT user_id) AS number_of_entities, count(*) AS changes_detected,
             round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100000, 3) AS scan_duration_seconds FROM events GROUP BY 1)"""


def _history(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    per_user = events.groupBy(F.to_date("ts").alias("scan_date"), "user_id").agg(
        F.max("ts").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v")
    )
    return per_user.groupBy("scan_date").agg(
        F.max("t").alias("scan_timestamp"), F.count(F.lit(1)).alias("number_of_entities"), F.sum("n").alias("changes_detected"),
        F.round(F.sum("v").cast("double") / 100000, 3).alias("scan_duration_seconds"),
    )


@query(
    "scan_history_daily",
    f"""WITH {HISTORY_SQL} SELECT scan_date, CAST(1 AS BIGINT) AS scans, number_of_entities AS entities, CAST(changes_detected AS BIGINT) AS changes_detected,
scan_duration_seconds AS mean_duration, scan_duration_seconds AS max_duration FROM h""",
)
def scan_history_daily(spark: SparkSession, folder: str) -> DataFrame:
    return H.daily_statistics(_history(spark, folder))


@query(
    "scan_history_log",
    f"WITH {HISTORY_SQL} SELECT scan_timestamp, number_of_entities, changes_detected, scan_duration_seconds FROM h",
)
def scan_history_log(spark: SparkSession, folder: str) -> DataFrame:
    """The history written to its log and read back; the second write of the batch replaces the first."""
    root = new_work_dir(spark, "history")
    rows = _history(spark, folder).drop("scan_date")
    for _ in range(2):
        logs.append_log(rows, root, monitor.HISTORY_LOG, "import")
    return monitor.scan_history(spark, root).drop("batch_id")


@query("events_per_scan", f"WITH {USER_EVENTS_SQL} SELECT CAST(ts AS DATE) AS scan_date, count(*) AS changes_detected FROM e GROUP BY 1")
def events_per_scan(spark: SparkSession, folder: str) -> DataFrame:
    events = user_events(spark, folder)
    return E.events_per_batch(events.withColumn("scan_date", F.to_date(F.substring("detected_at", 1, 10))), "scan_date")


@query("latest_scan", "SELECT date_trunc('day', max(ts)) AS latest_scan FROM events")
def latest_scan(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "events").select(F.date_trunc("day", "ts").alias("created_at"))
    return B.latest_scan(snapshots, _history(spark, folder))
