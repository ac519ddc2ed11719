"""Versioned data derived from the given tables, in Spark and as SQL text.

Every row of a table takes part; the arithmetic on ids only decides in which of the two versions a
row exists and how it differs, since the tables themselves have one version each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import text as X
from driftmark.operators import events as E
from driftmark.operators import versions as G
from driftmark.operators.skew import OrderedKeys
from driftmark.plans.registry import table

# ---- documents: two snapshots --------------------------------------------------------------------

DOC_FIELDS = ["source", "text", "lang"]

DOCUMENTS_SQL = r"""
b AS (SELECT doc_id, source, text, lang FROM documents WHERE doc_id % 31 <> 0),
a AS (SELECT doc_id,
             CASE WHEN doc_id % 7 = 0 THEN source || '_x' ELSE source END AS source,
             CASE WHEN doc_id % 11 = 0 THEN replace(text, '. ', '! ') ELSE text END AS text,
             lang
      FROM documents WHERE doc_id % 29 <> 0 OR doc_id % 31 = 0)"""


def document_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", *DOC_FIELDS)
    before = docs.filter("doc_id % 31 <> 0")
    after = docs.filter("doc_id % 29 <> 0 or doc_id % 31 = 0").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit("_x"))).otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 11 == 0, F.replace("text", F.lit(". "), F.lit("! "))).otherwise(F.col("text")).alias("text"),
        "lang",
    )
    return before, after


CHANGED_TEXTS_SQL = DOCUMENTS_SQL + """,
t AS (SELECT doc_id, b.text AS before, a.text AS after FROM b JOIN a USING (doc_id) WHERE b.text IS DISTINCT FROM a.text)"""


def changed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """`(doc_id, before, after)` of the documents whose text differs."""
    before, after = document_versions(spark, folder)
    pairs = before.select("doc_id", F.col("text").alias("before")).join(after.select("doc_id", F.col("text").alias("after")), "doc_id")
    return pairs.filter(~F.col("before").eqNullSafe(F.col("after")))


# ---- events: the version history of every user ------------------------------------------------------

VERSION_COLUMNS = ["event_id", "ts", "event_type", "value", "props"]


def user_versions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", *VERSION_COLUMNS)
    return G.consecutive_versions(rows, "user_id", ["ts", "event_id"], VERSION_COLUMNS)


USER_EVENTS_SQL = r"""
v AS (SELECT event_id, user_id, ts, event_type, value, props,
             lag(event_type) OVER w AS p_type, lag(value) OVER w AS p_value, lag(props) OVER w AS p_props, lag(ts) OVER w AS p_ts
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, 0 AS n, 'status' AS field, p_type AS before, event_type AS after FROM v
      UNION ALL SELECT *, 1, 'pricing_information', printf('%.2f', p_value), printf('%.2f', value) FROM v
      UNION ALL SELECT *, 2, 'source_update_notice', p_props, props FROM v
      UNION ALL SELECT *, 3, 'descriptive_texts.activity', p_type, event_type FROM v
      UNION ALL SELECT *, 4, 'evidence_summary_text', p_type, event_type FROM v),
e AS (SELECT event_id * 5 + n AS seq, CAST(user_id AS VARCHAR) AS entity_id, 'User ' || user_id AS entity_name,
             CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS manufacturer,
             CASE WHEN value < 2 THEN NULL ELSE 'https://users.example/' || user_id END AS entity_url,
             strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS detected_at,
             strftime(p_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS previous_snapshot_ts,
             strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS current_snapshot_ts,
             field, before, after,
             CASE WHEN field = 'status' THEN 'status_change'
                  WHEN field = 'pricing_information' THEN 'price_change'
                  WHEN before IS NOT NULL AND after IS NOT NULL THEN 'text_change'
                  ELSE 'other_field_change' END AS change_type,
             event_type = 'error' AS simulated, value < 1 AS development, ts
      FROM f WHERE before IS DISTINCT FROM after)"""


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """Change events of the user histories: five fields per version, flags taken from the row."""
    rows = user_versions(spark, folder)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    cents = lambda c: F.format_string("%.2f", c)
    old_value = F.when(F.col("previous.value").isNotNull(), cents(F.col("previous.value")))
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(field).alias("field"), before.alias("before"), after.alias("after"))
            for n, (field, before, after) in enumerate(
                [
                    ("status", F.col("previous.event_type"), F.col("event_type")),
                    ("pricing_information", old_value, cents(F.col("value"))),
                    ("source_update_notice", F.col("previous.props"), F.col("props")),
                    ("descriptive_texts.activity", F.col("previous.event_type"), F.col("event_type")),
                    ("evidence_summary_text", F.col("previous.event_type"), F.col("event_type")),
                ]
            )
        ]
    )
    different = F.filter(fields, lambda f: ~f["before"].eqNullSafe(f["after"]))
    flat = rows.withColumn("f", F.explode(different)).select("*", "f.*")
    kind = E.classify_change(F.col("field"), F.col("before").isNotNull(), F.col("after").isNotNull())
    tokens = F.array(
        F.struct(F.lit("delete").alias("op"), F.col("before").alias("text")), F.struct(F.lit("insert").alias("op"), F.col("after").alias("text"))
    )
    return flat.select(
        (F.col("event_id") * 5 + F.col("n")).alias("seq"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("entity_name"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("manufacturer"),
        F.when(F.col("value") >= 2, F.concat(F.lit("https://users.example/"), F.col("user_id").cast("string"))).alias("entity_url"),
        iso(F.col("ts")).alias("detected_at"),
        iso(F.col("previous.ts")).alias("previous_snapshot_ts"),
        iso(F.col("ts")).alias("current_snapshot_ts"),
        "field",
        "before",
        "after",
        kind.alias("change_type"),
        F.when(kind == presets.TEXT, tokens).alias("word_diff"),
        (F.col("event_type") == "error").alias("simulated"),
        (F.col("value") < 1).alias("development"),
    )


# ---- pages: two versions, and their paragraph and list sections ------------------------------------------

PAGES_SQL = r"""
pb AS (SELECT page_id, html FROM pages WHERE page_id % 13 <> 0),
pa AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '<p>', '<p>! ')
                            WHEN page_id % 7 = 0 THEN replace(html, '<li>', '<li>. ') ELSE html END AS html
       FROM pages WHERE page_id % 17 <> 0 OR page_id % 13 = 0)"""


def page_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, folder, "pages").select("page_id", "html")
    before = pages.filter("page_id % 13 <> 0")
    html = (
        F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<p>"), F.lit("<p>! ")))
        .when(F.col("page_id") % 7 == 0, F.replace("html", F.lit("<li>"), F.lit("<li>. ")))
        .otherwise(F.col("html"))
    )
    return before, pages.filter("page_id % 17 <> 0 or page_id % 13 = 0").select("page_id", html.alias("html"))


def _blocks_sql(pages: str, name: str) -> str:
    space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
    return rf"""
{name} AS (SELECT page_id, tag, page_id || ':' || tag AS stable_key,
                  CASE tag WHEN 'li' THEN 'field_value' ELSE 'section' END AS content_type,
                  'Page > ' || tag AS display_path,
                  trim(regexp_replace(block, '{space}', ' ', 'g')) AS content, position
           FROM (SELECT page_id, 'p' AS tag, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS block,
                        generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) AS position FROM {pages}
                 UNION ALL
                 SELECT page_id, 'li', unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)),
                        generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) FROM {pages})
           WHERE trim(regexp_replace(block, '{space}', ' ', 'g')) <> '')"""


BLOCKS_SQL = PAGES_SQL + "," + _blocks_sql("pb", "sb") + "," + _blocks_sql("pa", "sa")


def block_sections(pages: DataFrame) -> DataFrame:
    """Paragraphs and list items of every page as section rows, found by pattern."""
    found = F.array(
        F.struct(F.lit("p").alias("tag"), F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)).alias("blocks")),
        F.struct(F.lit("li").alias("tag"), F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1)).alias("blocks")),
    )
    tags = pages.select("page_id", F.explode(found).alias("t"))
    rows = tags.select("page_id", "t.tag", F.posexplode("t.blocks").alias("at", "block"))
    return rows.select(
        "page_id",
        F.array(F.lit("Page"), "tag").alias("path"),
        F.concat_ws(":", F.col("page_id").cast("string"), "tag").alias("stable_key"),
        F.when(F.col("tag") == "li", "field_value").otherwise("section").alias("content_type"),
        F.lit(presets.SOURCE_KIND).alias("source_kind"),
        F.col("block").alias("content"),
        (F.col("at") + 1).alias("position"),
    ).filter(X.has_text(F.col("content")))


# ---- price lists per part --------------------------------------------------------------------------------------

PRICE_LINE = ["amount", "start", "end", "currency"]

PRICES_SQL = r"""
r AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS ship FROM lineitem),
lb AS (SELECT l_partkey AS part, printf('%.6f', l_extendedprice) AS amount, ship AS start, '' AS "end", 'EUR' AS currency,
              row_number() OVER (PARTITION BY l_partkey ORDER BY ship, l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS pos FROM r),
la AS (SELECT l_partkey AS part, printf('%.6f', CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice * 1.1 ELSE l_extendedprice END) AS amount,
              CASE WHEN l_partkey % 7 = 0 THEN '2002-01-01' ELSE ship END AS start, '' AS "end", 'EUR' AS currency,
              row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber, l_suppkey, ship, l_extendedprice) AS pos FROM r),
gb AS (SELECT part, list((amount, start, "end", currency) ORDER BY pos) AS lines, list(DISTINCT amount) AS amounts FROM lb GROUP BY part),
ga AS (SELECT part, list((amount, start, "end", currency) ORDER BY pos) AS lines, list(DISTINCT amount) AS amounts FROM la GROUP BY part),
verdicts AS (
  SELECT part, len(gb.lines) AS lines_before, len(ga.lines) AS lines_after,
         CASE WHEN list_sort(gb.amounts) <> list_sort(ga.amounts) THEN 'amount'
              WHEN list_sort(gb.lines) <> list_sort(ga.lines) THEN 'period' ELSE 'order' END AS verdict
  FROM gb JOIN ga USING (part) WHERE gb.lines <> ga.lines)"""


def price_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Price lines `(part, amount, start, end, currency, position)` before and after."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"), (-F.col("l_orderkey")).alias("newest"),
    )

    def shaped(df: DataFrame, price, start) -> DataFrame:
        return df.select(
            "part", F.format_string("%.6f", price).alias("amount"), start.alias("start"), F.lit("").alias("end"),
            F.lit("EUR").alias("currency"), "position",
        )

    old = OrderedKeys(lines, ["part"], ["ship", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"]).positions("position")
    new = OrderedKeys(lines, ["part"], ["newest", "l_linenumber", "l_suppkey", "ship", "l_extendedprice"]).positions("position")
    price = F.col("l_extendedprice")
    raised = F.when(F.col("part") % 5 == 0, price * 1.1).otherwise(price)
    moved = F.when(F.col("part") % 7 == 0, F.lit("2002-01-01")).otherwise(F.col("ship"))
    return shaped(old, price, F.col("ship")), shaped(new, raised, moved)
