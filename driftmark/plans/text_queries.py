"""Text diffs and text functions over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import money as M
from driftmark.functions import text as X
from driftmark.operators import assembly as A
from driftmark.operators import events as E
from driftmark.operators import feed as B
from driftmark.operators import moved
from driftmark.operators import textdiff as W
from driftmark.plans.registry import query, table
from driftmark.plans.versions_of_tables import CHANGED_TEXTS_SQL, changed_texts
from driftmark.presets import DEFAULT

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _clean(column: str) -> str:
    return rf"trim(regexp_replace({column}, '{SPACE}', ' ', 'g'))"


WORDS_SQL = CHANGED_TEXTS_SQL + f""",
wb AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_clean('before')}, ' ')) AS word FROM t) WHERE word <> '' GROUP BY ALL),
wa AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_clean('after')}, ' ')) AS word FROM t) WHERE word <> '' GROUP BY ALL)"""


@query(
    "text_change_bag_stats",
    f"""WITH {WORDS_SQL}
SELECT coalesce(wb.doc_id, wa.doc_id) AS doc_id,
       CAST(sum(greatest(coalesce(wb.n, 0) - coalesce(wa.n, 0), 0)) AS BIGINT) AS words_removed,
       CAST(sum(greatest(coalesce(wa.n, 0) - coalesce(wb.n, 0), 0)) AS BIGINT) AS words_added
FROM wb FULL JOIN wa ON wa.doc_id = wb.doc_id AND wa.word = wb.word
GROUP BY 1 HAVING words_removed > 0 OR words_added > 0""",
)
def text_change_bag_stats(spark: SparkSession, folder: str) -> DataFrame:
    return W.bag_statistics(changed_texts(spark, folder), "doc_id", "before", "after")


@query(
    "long_text_changes",
    f"""WITH {CHANGED_TEXTS_SQL},
n AS (SELECT doc_id, length(before) AS cb, length(after) AS ca,
             len(list_filter(string_split({_clean('before')}, ' '), lambda w: w <> '')) AS nb,
             len(list_filter(string_split({_clean('after')}, ' '), lambda w: w <> '')) AS na FROM t)
SELECT doc_id, cb > 400 OR ca > 400 OR nb > 60 OR na > 60 AS is_long, CAST(nb AS BIGINT) AS words_before, CAST(na AS BIGINT) AS words_after FROM n""",
)
def long_text_changes(spark: SparkSession, folder: str) -> DataFrame:
    before, after = F.col("before"), F.col("after")
    return changed_texts(spark, folder).select(
        "doc_id", W.is_long_text(before, after).alias("is_long"),
        X.word_count(before).cast("bigint").alias("words_before"), X.word_count(after).cast("bigint").alias("words_after"),
    )


def _diffed(spark: SparkSession, folder: str) -> DataFrame:
    pairs = W.spread_pairs(changed_texts(spark, folder), "doc_id")
    return pairs.withColumn("tokens", W.word_diff("before", "after"))


@query("word_diff")
def word_diff(spark: SparkSession, folder: str) -> DataFrame:
    # A plain posexplode lets the optimizer filter on the size of the tokens below the exchange, with a diff of its own.
    tokens = _diffed(spark, folder).select("doc_id", F.posexplode_outer("tokens").alias("position", "t"))
    return tokens.filter("position is not null").select("doc_id", "position", "t.*")


@query(
    "word_diff_restores_both_sides",
    f"""WITH {CHANGED_TEXTS_SQL} SELECT doc_id, md5({_clean('before')}) AS before_md5, md5({_clean('after')}) AS after_md5 FROM t""",
)
def word_diff_restores_both_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Equal and deleted words give the text before, equal and inserted words the text after."""
    side = lambda op: F.md5(W.joined(F.filter("tokens", lambda t: t["op"].isin("equal", op))))
    return _diffed(spark, folder).select("doc_id", side("delete").alias("before_md5"), side("insert").alias("after_md5"))


@query("text_change_kind")
def text_change_kind(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.col("tokens")
    kinds = _diffed(spark, folder).withColumn("kind", W.text_change_kind(tokens))
    return kinds.select(
        "doc_id", "kind", W.changed_words(tokens, "delete").alias("words_removed"), W.changed_words(tokens, "insert").alias("words_added"),
        W.long_text_summary(tokens, F.col("kind")).alias("long_summary"),
        E.summary(F.lit("text_change"), F.lit("description"), F.col("kind"), F.col("before"), F.col("after")).alias("summary"),
    )


@query("changed_phrases")
def changed_phrases(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.col("tokens")
    return _diffed(spark, folder).select(
        "doc_id", W.first_changed_phrase(tokens, "delete").alias("first_removed"), W.first_changed_phrase(tokens, "insert").alias("first_added"),
        W.changed_text(tokens, "insert").alias("all_added"), F.md5(W.phrase_signature(tokens)).alias("signature"),
    )


@query("excerpt_windows")
def excerpt_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _diffed(spark, folder).withColumn("windows", W.excerpt_windows(F.col("tokens")))
    tokens, windows = F.col("tokens"), F.col("windows")
    return rows.select(
        "doc_id", W.joined(W.excerpt_side(tokens, windows, "before")).alias("before_excerpt"),
        W.joined(W.excerpt_side(tokens, windows, "after")).alias("after_excerpt"), W.excerpt_truncated(tokens, windows).alias("truncated"),
    )


@query("line_diff")
def line_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = _diffed(spark, folder).withColumn("lines", W.unified_lines("before", "after"))
    full = W.line_diff(F.col("before"), F.col("after"), F.col("lines"), F.col("tokens"))
    return rows.select("doc_id", F.posexplode(full).alias("position", "line"))


@query("diff_excerpts")
def diff_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    pairs = W.spread_pairs(changed_texts(spark, folder), "doc_id").withColumn("runs", W.word_runs("before", "after"))
    return pairs.select("doc_id", F.size("runs").alias("runs"), W.diff_excerpt(F.col("runs")).alias("diff_excerpt"))


@query(
    "moved_text_suppression",
    f"""WITH d AS (SELECT doc_id, source, lang, {_clean('text')} AS text FROM documents),
w AS (SELECT *, len(string_split(text, ' ')) AS n FROM d)
SELECT doc_id, n >= 20 AND lang = 'en' AS moved FROM w""",
)
def moved_text_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text leaves the evidence field; it stays among the descriptions of English documents only."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", X.clean_text(F.col("text")).alias("text"))
    blob = F.when(F.col("lang") == "en", X.normalize_text(F.concat_ws(" ", F.lit("Über:"), "text", F.lit("Ende")))).otherwise(F.lit("ende"))
    runs = W.word_runs(F.concat_ws(" ", "text", F.lit("Fazit")), F.lit("Fazit"))
    rows = docs.withColumn("runs", runs)
    return rows.select("doc_id", E.moved_text(W.removed_runs(F.col("runs")), blob).alias("moved"))


@query(
    "moved_events_on_read",
    f"""WITH d AS (SELECT doc_id, lang, {_clean('text')} AS text FROM documents),
w AS (SELECT *, len(string_split(text, ' ')) AS n FROM d),
m AS (SELECT doc_id, n >= 20 AND lang IN ('en', CASE doc_id % 2 WHEN 0 THEN 'de' ELSE 'fr' END) AS moved FROM w)
SELECT doc_id AS seq, moved, NOT moved AS shown FROM m""",
)
def moved_events_on_read(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events in which the whole text leaves the evidence field, judged by the nearest of two snapshots.

    The text is among the descriptions of English entities in both snapshots, of German ones in the first and of French ones
    in the second; events know their entity by id, name or address, in other case than the snapshots.
    """
    docs = table(spark, folder, "documents").select("doc_id", "lang", X.clean_text(F.col("text")).alias("text"))
    key, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    name, url = F.concat(F.lit("Entity "), key), F.concat(F.lit("https://entities.example/"), key)
    events = docs.select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ID-"), key)).alias("entity_id"),
        F.when(F.col("doc_id") % 3 == 1, F.upper(name)).alias("entity_name"), F.when(F.col("doc_id") % 3 == 2, F.upper(url)).alias("entity_url"),
        F.lit(DEFAULT.evidence_field).alias("field"), F.lit(presets.TEXT).alias("change_type"),
        F.concat_ws(" ", "text", F.lit("Fazit")).alias("before"), F.lit("Fazit").alias("after"),
        F.when(even, "2026-06-01T09:00:00+00:00").otherwise("2026-06-02T07:00:00+00:00").alias("current_snapshot_ts"),
    )
    shots = spark.createDataFrame([("s1", "2026-06-01T08:00:00"), ("s2", "2026-06-02T08:00:00")], "snapshot_id string, at string")
    shots = shots.select("snapshot_id", F.to_timestamp("at").alias("taken_at"))
    both = docs.withColumn("snapshot_id", F.explode(F.array(F.lit("s1"), F.lit("s2"))))
    stays = F.col("lang").isin("en") | (F.col("lang") == F.when(F.col("snapshot_id") == "s1", "de").otherwise("fr"))
    doc = F.struct(F.struct(F.when(stays, F.concat_ws(" ", F.lit("Über:"), "text", F.lit("Ende"))).otherwise("Ende").alias("activity")).alias("descriptive_texts"))
    entries = both.select(
        "snapshot_id", F.col("doc_id").alias("pos"), F.concat(F.lit("id-"), key).alias("entity_id"), F.lit(None).cast("string").alias("identifier"),
        name.alias("entity_name"), url.alias("entity_url"), F.to_variant_object(doc).alias("doc"),
    )
    marked = moved.mark_moved(events, shots, entries)
    return marked.select("seq", "moved", B.is_real(marked).alias("shown"))


@query(
    "description_blobs",
    rf"""SELECT doc_id, md5(trim(regexp_replace(lower(source || ' ' || text), '{SPACE}', ' ', 'g'))) AS blob_md5 FROM documents""",
)
def description_blobs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    doc = F.to_variant_object(F.struct(F.struct("source", "text").alias("descriptive_texts")))
    return docs.select("doc_id", F.md5(E.description_blob(doc)).alias("blob_md5"))


LABEL_SQL = f"""
l AS (SELECT doc_id, source, lang, text, source || ' Ä/ö ' || lang || ' & Co: ' || text AS labelled FROM documents)"""


@query(
    "scalar_text",
    rf"""WITH {LABEL_SQL}
SELECT doc_id, md5({_clean('text')}) AS clean_md5, md5(lower({_clean('text')})) AS normal_md5,
       md5({_clean("substr(labelled, strpos(labelled, ':') + 1)")}) AS unlabelled_md5,
       source || '-aeoe' AS slug,
       CASE WHEN length({_clean('text')}) <= 180 THEN {_clean('text')} ELSE rtrim(substr({_clean('text')}, 1, 177)) || '...' END AS compacted,
       coalesce(nullif(trim(lang), ''), source) AS first_text,
       substr(sha1('aeoe-' || source), 1, 10) AS key_digest,
       CASE WHEN len(string_split({_clean('text')}, ' ')) <= 36 THEN text
            ELSE array_to_string(list_slice(string_split({_clean('text')}, ' '), 1, 36), ' ') || ' ...' END AS excerpt,
       CASE WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 237) || '...' END AS preview
FROM l""",
)
def scalar_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")
    labelled = F.concat(source, F.lit(" Ä/ö "), lang, F.lit(" & Co: "), text)
    return docs.select(
        "doc_id",
        F.md5(X.clean_text(text)).alias("clean_md5"),
        F.md5(X.normalize_text(text)).alias("normal_md5"),
        F.md5(X.clean_text(X.strip_leading_label(labelled))).alias("unlabelled_md5"),
        X.slugify(F.concat(F.lit(" "), source, F.lit(" -- Äö! "))).alias("slug"),
        X.compact(text, 180).alias("compacted"),
        X.first_text(F.lit("  "), lang, source).alias("first_text"),
        F.substring_index(X.key_part(F.concat(F.lit("Äö "), source)), "-", -1).alias("key_digest"),
        X.first_words(text).alias("excerpt"),
        X.preview(text).alias("preview"),
    )


@query(
    "text_sections",
    r"""WITH k AS (SELECT doc_id, text, lang, source, CASE lang WHEN 'de' THEN 'questionnaire.Nachweis der Studie: ' || source WHEN 'fr' THEN 'health_app.data_description'
       WHEN 'es' THEN 'questionnaire.Datenschutz ' || source ELSE 'questionnaire.' || source END AS key FROM documents),
r AS (SELECT *, CASE lang WHEN 'fr' THEN 'data description' ELSE substr(key, 15) END AS label,
             CASE lang WHEN 'de' THEN 'Informationen zum positiven Versorgungseffekt' WHEN 'es' THEN 'Informationen zu Datenschutz und Datensicherheit'
                       ELSE 'Beschreibung der DiGA' END AS section FROM k),
s AS (SELECT *, trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-') AS s1, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS s2,
             trim(regexp_replace(lower(key), '[^a-z0-9]+', '-', 'g'), '-') AS s3 FROM r)
SELECT doc_id, 'descriptive_texts.' || key AS field_path, 'descriptive-texts|' || s1 || '|' || s1 || '|' || s2 || '|' || s3 AS stable_key,
       section AS main_section, label AS question_label, section || ' > ' || label AS display_path, 'high' AS localization_confidence, md5(text) AS text_md5 FROM s""",
)
def text_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).select(
        F.col("entity_id").alias("doc_id"), "field_path", "stable_key", "main_section", "question_label", "display_path", "localization_confidence",
        F.md5("text").alias("text_md5"),
    )


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    key = (
        F.when(lang == "de", F.concat(F.lit("questionnaire.Nachweis der Studie: "), source))
        .when(lang == "fr", F.lit("health_app.data_description"))
        .when(lang == "es", F.concat(F.lit("questionnaire.Datenschutz "), source))
        .otherwise(F.concat(F.lit("questionnaire."), source))
    )
    return A.text_sections(table(spark, folder, "documents").select(F.col("doc_id").alias("entity_id"), key.alias("key"), "text"))


@query(
    "section_context_lookup",
    r"""WITH k AS (SELECT doc_id, lang, source, CASE lang WHEN 'de' THEN 'questionnaire.Nachweis der Studie: ' || source WHEN 'fr' THEN 'health_app.data_description'
       WHEN 'es' THEN 'questionnaire.Datenschutz ' || source ELSE 'questionnaire.' || source END AS key FROM documents)
SELECT doc_id, 'descriptive_texts.' || key AS field,
       CASE lang WHEN 'de' THEN 'Informationen zum positiven Versorgungseffekt' WHEN 'es' THEN 'Informationen zu Datenschutz und Datensicherheit'
                 ELSE 'Beschreibung der DiGA' END AS main_section FROM k
UNION ALL SELECT doc_id, 'status', NULL FROM documents""",
)
def section_context_lookup(spark: SparkSession, folder: str) -> DataFrame:
    sections = _sections(spark, folder).select(F.col("entity_id").alias("doc_id"), "field_path", "main_section", F.lit(0).alias("position"))
    changes = sections.select("doc_id", F.col("field_path").alias("field")).unionByName(
        table(spark, folder, "documents").select("doc_id", F.lit("status").alias("field"))
    )
    found = E.section_context(changes, sections, "doc_id", "position", ["main_section"])
    return found.select("doc_id", "field", F.col("context.main_section").alias("main_section"))


@query(
    "inferred_contexts",
    r"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'Weitere Informationen' ELSE 'Beschreibung der DiGA' END AS main_section,
  CASE WHEN lang = 'de' THEN 'Kosten ' || source ELSE 'x ' || source END AS question_label,
  CASE WHEN lang = 'de' THEN 'Weitere Informationen > Kosten ' || source ELSE 'Beschreibung der DiGA > x ' || source END AS display_path,
  'medium' AS localization_confidence FROM documents""",
)
def inferred_contexts(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("lang") == "de", F.lit("Kosten_")).otherwise(F.lit("x_"))
    field = F.concat(F.lit("descriptive_texts.questionnaire.part."), label, "source")
    rows = table(spark, folder, "documents").select("doc_id", E.inferred_context(field).alias("c"))
    return rows.select("doc_id", "c.main_section", "c.question_label", "c.display_path", "c.localization_confidence")


@query(
    "display_paths",
    r"""SELECT doc_id, lang || ' > Steckbrief der DiGA > ' || source AS path, source AS title, lang || ' > Steckbrief der DiGA' AS parents FROM documents""",
)
def display_paths(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.col("lang"), F.lit(" > Bitte beschreiben: Steckbrief dieser DiGA: >  > "), F.col("source"), F.lit(" "))
    rows = table(spark, folder, "documents").select("doc_id", raw.alias("raw"))
    path = F.col("raw")
    return rows.select(
        "doc_id", X.display_path(path).alias("path"), X.path_title(path).alias("title"), X.path_parents(path).alias("parents")
    )


@query(
    "description_keys",
    rf"""SELECT doc_id, length({_clean('text')}) >= 40 AND lang IN ('de', 'en') AS is_description FROM documents""",
)
def description_keys(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("lang")
    path = F.when(lang == "de", F.lit("extension.0.valueSubtitle")).when(lang == "en", F.lit("Purpose.0")).otherwise(F.concat(F.lit("misc."), lang))
    return table(spark, folder, "documents").select("doc_id", A.is_description(path, X.clean_text(F.col("text"))).alias("is_description"))


@query(
    "money_in_text",
    r"""SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS price, replace(printf('%.2f', l_extendedprice), '.', ',') || ' EUR' AS said,
  printf('%.6f', l_extendedprice) AS amount, 'EUR' AS currency,
  CAST(CASE WHEN printf('%.2f', l_extendedprice) = printf('%.2f', l_quantity) THEN 1 ELSE 2 END AS BIGINT) AS mentions FROM lineitem""",
)
def money_in_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    said = F.concat(F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")), F.lit(" EUR"))
    text = F.concat(F.lit("Preis "), said, F.lit(", Menge "), F.format_string("%.2f", "l_quantity"), F.lit(" eur"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("price"), said.alias("said"), M.amounts_in_text(text).alias("found"))
    split = M.split_amount(F.element_at("found", 1))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "price", "said", split["amount"].alias("amount"), split["currency"].alias("currency"),
        F.size("found").cast("bigint").alias("mentions"),
    )
