"""Snapshot diff and change events over the document versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import text as X
from driftmark.functions import variant as V
from driftmark.operators import entity_diff as C
from driftmark.operators import events as E
from driftmark.operators import identity as I
from driftmark.operators import node_diff as N
from driftmark.plans import monitor
from driftmark.plans.registry import query, table
from driftmark.plans.versions_of_tables import DOC_FIELDS, DOCUMENTS_SQL, document_versions, user_versions
from driftmark.session import new_work_dir
from driftmark.sources import snapshots


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    before, after = document_versions(spark, folder)
    return C.classify_entities(before, after, "doc_id", DOC_FIELDS)


@query(
    "snapshot_diff_summary",
    f"""WITH {DOCUMENTS_SQL}
SELECT kind, count(*) AS entities FROM (
  SELECT CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed'
              WHEN (b.source, b.text, b.lang) IS NOT DISTINCT FROM (a.source, a.text, a.lang) THEN 'unchanged' ELSE 'changed' END AS kind
  FROM b FULL JOIN a ON a.doc_id = b.doc_id) GROUP BY kind""",
)
def snapshot_diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.diff_summary(_kinds(spark, folder))


def _named(df: DataFrame) -> DataFrame:
    """Entities under their identity and display name: id first, else source; source first, else id."""
    return df.select(
        I.flat_identity([F.col("doc_id"), F.col("source")], F.lit("unknown")).alias("entity_id"),
        I.flat_identity([F.col("source"), F.col("doc_id")], F.lit(presets.UNNAMED)).alias("entity_name"),
    )


@query(
    "entity_added",
    f"""WITH {DOCUMENTS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS entity_id, source AS entity_name FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)""",
)
def entity_added(spark: SparkSession, folder: str) -> DataFrame:
    before, after = document_versions(spark, folder)
    return _named(after.select("doc_id", "source").join(before.select("doc_id"), "doc_id", "left_anti"))


@query(
    "entity_removed",
    f"""WITH {DOCUMENTS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS entity_id, source AS entity_name FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
)
def entity_removed(spark: SparkSession, folder: str) -> DataFrame:
    before, after = document_versions(spark, folder)
    return _named(before.select("doc_id", "source").join(after.select("doc_id"), "doc_id", "left_anti"))


FIELD_CHANGES_SQL = DOCUMENTS_SQL + """,
p AS (SELECT b.doc_id, b.source AS b_source, a.source AS a_source, b.text AS b_text, a.text AS a_text, b.lang AS b_lang, a.lang AS a_lang
      FROM b JOIN a ON a.doc_id = b.doc_id),
c AS (SELECT doc_id, 'status' AS field, b_source AS before, a_source AS after FROM p WHERE b_source IS DISTINCT FROM a_source
      UNION ALL SELECT doc_id, 'description', b_text, a_text FROM p WHERE b_text IS DISTINCT FROM a_text
      UNION ALL SELECT doc_id, 'manufacturer', b_lang, a_lang FROM p WHERE b_lang IS DISTINCT FROM a_lang)"""
ROLES = {"source": "status", "text": "description", "lang": "manufacturer"}


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    before, after = document_versions(spark, folder)
    renamed = [df.select("doc_id", *[F.col(c).alias(r) for c, r in ROLES.items()]) for df in (before, after)]
    pairs = C.pair_entities(*renamed, "doc_id", list(ROLES.values()))
    return C.field_changes(pairs, "doc_id", list(ROLES.values()))


@query("field_changes", f"WITH {FIELD_CHANGES_SQL} SELECT doc_id, field, before, after FROM c")
def field_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder)


@query("changed_field_counts", f"WITH {FIELD_CHANGES_SQL} SELECT doc_id, count(*) AS changed_fields FROM c GROUP BY doc_id")
def changed_field_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.changed_field_counts(_changes(spark, folder), "doc_id")


EVENTS_SQL = FIELD_CHANGES_SQL + """,
ev AS (SELECT doc_id, 'new_diga' AS change_type, '<entry>' AS field, CAST(NULL AS VARCHAR) AS before, source AS after FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
       UNION ALL SELECT doc_id, 'removed_diga', '<entry>', source, NULL FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
       UNION ALL SELECT doc_id, CASE field WHEN 'status' THEN 'status_change' ELSE 'text_change' END, field, before, after FROM c),
lab AS (SELECT *, CASE field WHEN 'status' THEN 'Aufnahmestatus' WHEN 'manufacturer' THEN 'Hersteller' ELSE field END AS field_label,
               CASE change_type WHEN 'new_diga' THEN 'Neue DiGA' WHEN 'removed_diga' THEN 'Nicht mehr gefunden'
                                WHEN 'status_change' THEN 'Statusänderung' ELSE 'Textänderung' END AS title FROM ev)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Flat events: added, removed and field changes from one full outer join."""
    before, after = document_versions(spark, folder)
    renamed = [df.select("doc_id", *[F.col(c).alias(r) for c, r in ROLES.items()]) for df in (before, after)]
    fields = list(ROLES.values())
    pairs = C.pair_entities(*renamed, "doc_id", fields)
    struct = lambda kind, field, old, new: F.struct(
        kind.alias("change_type"), F.lit(field).alias("field"), old.alias("before"), new.alias("after")
    )
    none = F.lit(None).cast("string")
    is_new, is_gone = F.col("before").isNull(), F.col("after").isNull()
    whole = F.array(
        F.when(is_new, struct(F.lit(presets.ADDED), presets.ENTRY_FIELD, none, F.col("after.status"))).otherwise(
            struct(F.lit(presets.REMOVED), presets.ENTRY_FIELD, F.col("before.status"), none)
        )
    )
    parts = F.array(
        *[
            struct(E.classify_change(F.lit(f), F.col(f"before.{f}").isNotNull(), F.col(f"after.{f}").isNotNull()), f, F.col(f"before.{f}"), F.col(f"after.{f}"))
            for f in fields
        ]
    )
    changed = F.filter(parts, lambda p: ~p["before"].eqNullSafe(p["after"]))
    rows = pairs.select("doc_id", F.explode(F.when(is_new | is_gone, whole).otherwise(changed)).alias("e")).select("doc_id", "e.*")
    return rows.withColumn("field_label", X.label_for(F.col("field"), presets.EVENT_FIELD_LABELS)).withColumn(
        "title", E.event_title(F.col("change_type"), F.col("after"))
    )


@query("change_events", f"WITH {EVENTS_SQL} SELECT doc_id, change_type, field, before, after, field_label, title FROM lab")
def change_events(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder)


@query("change_type_counts", f"WITH {EVENTS_SQL} SELECT change_type, field, count(*) AS events FROM ev GROUP BY change_type, field")
def change_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy("change_type", "field").agg(F.count(F.lit(1)).alias("events"))


@query(
    "event_summaries",
    f"""WITH {EVENTS_SQL}
SELECT doc_id, field, CASE change_type
  WHEN 'new_diga' THEN 'Eine neue DiGA wurde in das Verzeichnis aufgenommen.'
  WHEN 'removed_diga' THEN 'Eine DiGA ist im aktuellen Verzeichnis nicht mehr vorhanden.'
  WHEN 'status_change' THEN 'Der Aufnahmestatus wurde von ''' || before || ''' auf ''' || after || ''' geändert.'
  ELSE 'Im Abschnitt ''' || field_label || ''' wurde Text geändert.' END AS summary,
  CASE change_type WHEN 'new_diga' THEN 'Eine neue DiGA wurde aufgenommen.' WHEN 'removed_diga' THEN 'Eine DiGA wurde gestrichen.'
  WHEN 'status_change' THEN 'Der Aufnahmestatus wurde geändert.' ELSE 'Text wurde geändert.' END AS short_description
FROM lab""",
)
def event_summaries(spark: SparkSession, folder: str) -> DataFrame:
    mixed = F.lit("mixed_text_change")
    return _events(spark, folder).select(
        "doc_id", "field",
        E.summary(F.col("change_type"), F.col("field_label"), mixed, F.col("before"), F.col("after")).alias("summary"),
        E.short_description(F.col("change_type"), mixed).alias("short_description"),
    )


@query(
    "key_sets",
    f"""WITH {DOCUMENTS_SQL}
SELECT 'only_after' AS set_name, doc_id FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)
UNION ALL SELECT 'only_before', doc_id FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)
UNION ALL SELECT 'in_both', doc_id FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)
UNION ALL SELECT 'in_either', doc_id FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)""",
)
def key_sets(spark: SparkSession, folder: str) -> DataFrame:
    before, after = document_versions(spark, folder)
    return C.key_sets(before, after, "doc_id")


PATHS_SQL = """
paths AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'raw_public_fhir.' || source WHEN 'fr' THEN 'structured_text_sections'
                                   WHEN 'es' THEN 'raw_public_fhirs.' || source ELSE 'descriptive_texts.' || source END AS path FROM documents)"""


@query(
    "ignored_paths",
    f"""WITH {PATHS_SQL}
SELECT path, path IN ('structured_text_sections', 'content_sections', 'rendered_structure_metadata')
  OR path = 'raw_public_fhir' OR starts_with(path, 'raw_public_fhir.') AS ignored, count(*) AS rows FROM paths GROUP BY path""",
)
def ignored_paths(spark: SparkSession, folder: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    path = (
        F.when(lang == "de", F.concat(F.lit("raw_public_fhir."), source))
        .when(lang == "fr", F.lit("structured_text_sections"))
        .when(lang == "es", F.concat(F.lit("raw_public_fhirs."), source))
        .otherwise(F.concat(F.lit("descriptive_texts."), source))
    )
    counted = table(spark, folder, "documents").select(path.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("path", C.ignored_path(F.col("path")).alias("ignored"), "rows")


@query(
    "classified_fields",
    """SELECT field, change_type, count(*) AS rows FROM (
  SELECT field, CASE WHEN field = 'status' THEN 'status_change'
              WHEN contains(lower(field), 'price') OR contains(lower(field), 'pricing_information') OR contains(lower(field), 'preis') THEN 'price_change'
              WHEN role = 'user' THEN 'text_change' ELSE 'other_field_change' END AS change_type
  FROM (SELECT role, CASE WHEN turn = 0 THEN 'status' WHEN turn = 1 THEN 'Retail_Price.' || role WHEN turn = 2 THEN 'pricing_information'
                          WHEN turn = 3 THEN 'questionnaire.Preisangabe' ELSE 'turn_' || turn END AS field FROM conversations))
GROUP BY field, change_type""",
)
def classified_fields(spark: SparkSession, folder: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    field = (
        F.when(turn == 0, F.lit("status"))
        .when(turn == 1, F.concat(F.lit("Retail_Price."), role))
        .when(turn == 2, F.lit("pricing_information"))
        .when(turn == 3, F.lit("questionnaire.Preisangabe"))
        .otherwise(F.concat(F.lit("turn_"), turn.cast("string")))
    )
    rows = table(spark, folder, "conversations").select(field.alias("field"), role)
    text = F.col("role") == "user"
    typed = rows.select("field", E.classify_change(F.col("field"), text, text).alias("change_type"))
    return typed.groupBy("field", "change_type").agg(F.count(F.lit(1)).alias("rows"))


# ---- nested documents ------------------------------------------------------------------------------------

NESTED_SQL = """
v AS (SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             lag(event_id) OVER w AS p_id, lag(event_type) OVER w AS p_type, lag(value) OVER w AS p_value,
             lag(CAST(json_extract(props, '$.k') AS BIGINT)) OVER w AS p_k
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _document(prefix: str = ""):
    name = lambda c: F.col(prefix + c)
    return F.to_variant_object(
        F.struct(
            name("event_type").alias("type"),
            F.struct(F.format_string("%.2f", name("value")).alias("value"), F.lit("EUR").alias("currency")).alias("amount"),
            F.parse_json(name("props")).alias("props"),
        )
    )


@query(
    "nested_field_changes",
    f"""WITH {NESTED_SQL}
SELECT event_id, 'type' AS field, '"' || p_type || '"' AS before, '"' || event_type || '"' AS after FROM v WHERE p_id IS NOT NULL AND p_type IS DISTINCT FROM event_type
UNION ALL SELECT event_id, 'amount.value', '"' || printf('%.2f', p_value) || '"', '"' || printf('%.2f', value) || '"' FROM v
  WHERE p_id IS NOT NULL AND printf('%.2f', p_value) <> printf('%.2f', value)
UNION ALL SELECT event_id, 'props.k', CAST(p_k AS VARCHAR), CAST(k AS VARCHAR) FROM v WHERE p_id IS NOT NULL AND p_k IS DISTINCT FROM k""",
)
def nested_field_changes(spark: SparkSession, folder: str) -> DataFrame:
    rows = user_versions(spark, folder).filter("previous is not null")
    pairs = rows.select("event_id", _document("previous.").alias("before"), _document().alias("after"))
    changes = C.document_changes(pairs, max_depth=3)
    return changes.select("event_id", "field", V.canonical(F.col("before")).alias("before"), V.canonical(F.col("after")).alias("after"))


FLAT_SQL = DOCUMENTS_SQL + """,
n AS (SELECT b.doc_id, b.text AS b_text, a.text AS a_text, b.source AS b_source, a.source AS a_source, a.lang,
             json_object('source', b.source, 'tags', json_array(b.lang)) AS b_origin,
             CASE WHEN doc_id % 5 = 0 THEN 'gone' WHEN doc_id % 13 = 0 THEN 'text' ELSE 'whole' END AS shape
      FROM b JOIN a USING (doc_id))"""


@query(
    "flat_document_changes",
    f"""WITH {FLAT_SQL}
SELECT doc_id, 'text' AS field, CAST(to_json(b_text) AS VARCHAR) AS before, CAST(to_json(a_text) AS VARCHAR) AS after FROM n WHERE b_text IS DISTINCT FROM a_text
UNION ALL SELECT doc_id, 'meta.origin.source', CAST(to_json(b_source) AS VARCHAR), CAST(to_json(a_source) AS VARCHAR) FROM n
  WHERE shape = 'whole' AND b_source IS DISTINCT FROM a_source
UNION ALL SELECT doc_id, 'meta.origin', CAST(b_origin AS VARCHAR), NULL FROM n WHERE shape = 'gone'
UNION ALL SELECT doc_id, 'meta', CAST(json_object('lang', lang, 'origin', b_origin) AS VARCHAR), coalesce(CAST(to_json(lang) AS VARCHAR), 'null') FROM n WHERE shape = 'text'""",
)
def flat_document_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Nested documents of both versions as node tables; later ones lose a subtree, or have a text in its place."""
    before, after = document_versions(spark, folder)
    origin = F.struct("source", F.array("lang").alias("tags")).alias("origin")
    whole = F.to_variant_object(F.struct("text", F.struct("lang", origin).alias("meta")))
    gone = F.to_variant_object(F.struct("text", F.struct("lang").alias("meta")))
    text = F.to_variant_object(F.struct("text", F.col("lang").alias("meta")))
    later = F.when(F.col("doc_id") % 5 == 0, gone).when(F.col("doc_id") % 13 == 0, text).otherwise(whole)
    nodes = [N.node_table(df.select("doc_id", doc.alias("doc")), ["doc_id"]) for df, doc in ((before, whole), (after, later))]
    return N.NodeDiff(*nodes, ["doc_id"]).texts().select("doc_id", "field", "before", "after")


@query(
    "document_text_leaves",
    """SELECT event_id, 'type' AS path, event_type AS text FROM events
UNION ALL SELECT event_id, 'amount.value', printf('%.2f', value) FROM events
UNION ALL SELECT event_id, 'amount.currency', 'EUR' FROM events""",
)
def document_text_leaves(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "events").select("event_id", _document().alias("doc"))
    return V.text_leaves(docs, "doc", max_depth=4).select("event_id", F.array_join("path", ".").alias("path"), "text")


@query(
    "nested_values",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def nested_values(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "events").select("event_id", F.parse_json("props").alias("doc"))
    return docs.select("event_id", V.at(F.col("doc"), "k", "bigint").alias("k"), V.at(F.col("doc"), "k.0.x").alias("missing"))


@query(
    "display_values",
    """SELECT event_id, 'amount:currency:EUR' || chr(10) || 'value:' || printf('%.2f', value) || chr(10)
  || 'props:k:' || json_extract(props, '$.k') || chr(10) || 'type:' || event_type AS shown FROM events""",
)
def display_values(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "events").select("event_id", _document().alias("doc"))
    return docs.select("event_id", V.display_value(F.col("doc")).alias("shown"))


# ---- the snapshot store ---------------------------------------------------------------------------------------


@query("snapshot_store_diff", f"WITH {FIELD_CHANGES_SQL} SELECT CAST(doc_id AS VARCHAR) AS entity_id, field, before, after FROM c")
def snapshot_store_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Both versions go through the store: written, listed, read back, and diffed by fingerprint first."""
    root = new_work_dir(spark, "snapshots")
    for name, df in zip(("v1", "v2"), document_versions(spark, folder)):
        doc = F.to_variant_object(F.struct(*[F.col(c).alias(r) for c, r in ROLES.items()]))
        snapshots.write_snapshot(df.select(F.col("doc_id").cast("string").alias("entity_id"), doc.alias("doc")), root, name, name)
    previous, current = monitor.diff_latest(spark, root)
    pairs = monitor.pairs_to_compare(spark, root, previous, current)
    both = pairs.filter("before is not null and after is not null")
    changes = C.document_changes(both, max_depth=2)
    return changes.select("entity_id", "field", V.as_text(F.col("before")).alias("before"), V.as_text(F.col("after")).alias("after"))
