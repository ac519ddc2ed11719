"""Change events: classification, suppression of non-changes, context, labels and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark import presets
from driftmark.functions import text as X
from driftmark.functions import variant as V
from driftmark.operators import identity as I
from driftmark.operators import prices as P
from driftmark.operators import textdiff as W
from driftmark.operators.entity_diff import document_changes
from driftmark.presets import DEFAULT, Profile
from driftmark.session import cut_lineage

CONTEXT = (
    "main_section",
    "tab_label",
    "accordion_title",
    "source_area_label",
    "section_title",
    "subsection_title",
    "question_label",
    "section_field_label",
    "display_path",
    "stable_key",
    "localization_confidence",
)
FLAGS = ("simulated", "development", "is_development", "baseline_cleanup")


def classify_change(field: Column, before_is_text: Column, after_is_text: Column, profile: Profile = DEFAULT) -> Column:
    """status (exact field) before price (path marker) before text (both values strings) before other."""
    return (
        F.when(field == "status", F.lit(presets.STATUS))
        .when(X.contains_any(F.lower(field), profile.price_markers), F.lit(presets.PRICE))
        .when(before_is_text & after_is_text, F.lit(presets.TEXT))
        .otherwise(F.lit(presets.OTHER))
    )


def is_boilerplate(text: Column) -> Column:
    """Evidence text that is really the answer to the profile question."""
    lowered = F.lower(X.strip(text))
    hit = F.startswith(lowered, F.lit(presets.BOILERPLATE_START)) | F.contains(lowered, F.lit(presets.BOILERPLATE_PART))
    return F.coalesce(hit, F.lit(False))


def misplaced_text(field: Column, before: Column, after: Column, profile: Profile = DEFAULT) -> Column:
    return (field == profile.evidence_field) & (is_boilerplate(before) | is_boilerplate(after))


def moved_text(removed: Column, blob: Column) -> Column:
    """True when a removed run of at least 20 words is still part of the entity's descriptions."""

    def present(wanted: Column) -> Column:
        long = (wanted != "") & (F.size(F.split(wanted, " ")) >= presets.MOVED_MIN_WORDS)
        # The head is part of the run, so its presence decides for both.
        return long & F.contains(blob, F.substring(wanted, 1, presets.MOVED_PREFIX_CHARS))

    def found(run: Column) -> Column:
        return V.let(X.normalize_text(X.strip_leading_label(run)), present)

    return F.coalesce((blob != "") & F.exists(removed, found), F.lit(False))


def description_blob(doc: Column) -> Column:
    """All description values and section texts of an entity as one comparable string."""
    values = F.transform(F.map_values(V.as_object(V.member(doc, "descriptive_texts"))), lambda v: I.truthy_text(v))
    sections = F.transform(
        F.filter(V.as_list(V.member(doc, "structured_text_sections")), lambda s: V.as_object(s).isNotNull()),
        lambda s: F.coalesce(I.truthy_text(V.member(s, "text")), I.truthy_text(V.member(s, "raw_text")), F.lit("")),
    )
    empty = F.array().cast("array<string>")
    return X.normalize_text(
        F.array_join(F.concat(F.coalesce(F.array_compact(values), empty), F.coalesce(sections, empty)), " ")
    )


# ---- context ---------------------------------------------------------------------------------------


def _text(value) -> Column:
    return F.lit(value).cast("string")


def context_label(section: Column, subsection: Column) -> Column:
    """`section > subsection`, without repeating a part, or the phrase for unassigned text."""
    parts = X.distinct_truthy(F.array(section, subsection))
    return F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(F.lit(presets.UNASSIGNED_SECTION))


def inferred_context(field: Column, profile: Profile = DEFAULT) -> Column:
    """Context of a description field from its own path; null for other fields."""
    raw = F.regexp_replace(field, "^descriptive_texts\\.", "")
    raw = F.regexp_replace(raw, "^questionnaire\\.", "")
    tail = F.when(F.contains(raw, F.lit(".")), F.regexp_replace(raw, r"^[^.]*\.", "")).otherwise(raw)
    label = X.question_label(F.replace(tail, F.lit("_"), F.lit(" ")))

    def named(both: Column) -> Column:
        name, section = both["label"], both["section"]
        members = {
            **{c: section for c in ("main_section", "tab_label", "accordion_title", "source_area_label", "section_title")},
            **{c: name for c in ("subsection_title", "question_label", "section_field_label")},
            "display_path": context_label(section, name),
            "stable_key": _text(None),
            "localization_confidence": F.when(name != "", F.lit("medium")).otherwise(F.lit("low")),
        }
        return F.struct(*[X.truthy(members[c]).alias(c) for c in CONTEXT])

    def routed(name: Column) -> Column:
        return F.struct(name.alias("label"), X.route_section(name, profile.section_routes, profile.section_default).alias("section"))

    built = V.let(V.let(label, routed), named)
    return F.when(F.startswith(field, F.lit(presets.DESCRIPTION_PREFIX)), built)


def evidence_context(field: Column, before: Column, after: Column, profile: Profile = DEFAULT) -> Column:
    """Context of the evidence field; null for other fields."""
    low = is_boilerplate(before) | is_boilerplate(after)
    clear = {
        "main_section": presets.EVIDENCE_SECTION,
        "section_title": presets.EVIDENCE_SECTION,
        "display_path": presets.EVIDENCE_SECTION,
        "localization_confidence": "high",
    }
    sure = F.struct(*[_text(clear.get(c)).alias(c) for c in CONTEXT])
    unsure = F.struct(*[_text("low" if c == "localization_confidence" else None).alias(c) for c in CONTEXT])
    return F.when(field == profile.evidence_field, F.when(low, unsure).otherwise(sure))


def document_context(doc: Column, field: Column) -> Column:
    """Context of the first stored section whose path is the changed field, looked up inside the row."""
    hits = F.filter(
        V.as_list(V.member(doc, "structured_text_sections")), lambda s: V.as_text(V.member(s, "field_path")) == field
    )
    first = F.try_element_at(hits, F.lit(1))
    names = {c: "field_label" if c == "section_field_label" else c for c in CONTEXT}
    return F.when(
        first.isNotNull(), F.struct(*[I.truthy_text(V.member(first, names[c])).alias(c) for c in CONTEXT])
    )


def section_context(changes: DataFrame, sections: DataFrame, key: str, position: str, columns: Sequence[str]) -> DataFrame:
    """Table form of the lookup: the first section of the same entity and path, as struct `context`."""
    first = sections.groupBy(key, "field_path").agg(F.min_by(F.struct(*columns), F.col(position)).alias("context"))
    return changes.join(first.withColumnRenamed("field_path", "field"), [key, "field"], "left")


def merge_contexts(*contexts: Column) -> Column:
    """Member-wise: the first context that has a member decides it."""
    return F.struct(*[F.coalesce(*[c[name] for c in contexts]).alias(name) for name in CONTEXT])


# ---- labels and summaries -----------------------------------------------------------------------------


def summary(change_type: Column, label: Column, kind: Column, before: Column, after: Column) -> Column:
    """One sentence per event; `before` and `after` are display strings."""
    area = F.coalesce(label, F.lit(presets.UNKNOWN_AREA))
    text = None
    for name, template in presets.SUMMARY_TEXT.items():
        filled = F.format_string(template, area)
        text = F.when(kind == name, filled) if text is None else text.when(kind == name, filled)
    text = text.otherwise(F.format_string(presets.SUMMARY_TEXT_DEFAULT, area))
    old, new = F.coalesce(before, F.lit("None")), F.coalesce(after, F.lit("None"))
    return (
        F.when(change_type == presets.TEXT, text)
        .when(change_type == presets.PRICE, F.format_string(presets.SUMMARY_PRICE, old, new))
        .when(change_type == presets.STATUS, F.format_string(presets.SUMMARY_STATUS, old, new))
        .when(change_type == presets.ADDED, F.lit(presets.SUMMARY_ADDED))
        .when(change_type == presets.REMOVED, F.lit(presets.SUMMARY_REMOVED))
        .otherwise(F.format_string(presets.SUMMARY_OTHER, area))
    )


def short_description(change_type: Column, kind: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for p in presets.SHORT_TEXT.items() for x in p])
    others = F.create_map(*[F.lit(x) for p in presets.SHORT_OTHER.items() for x in p])
    return F.when(
        change_type == presets.TEXT, F.coalesce(F.try_element_at(texts, kind), F.lit(presets.SHORT_TEXT_DEFAULT))
    ).otherwise(F.coalesce(F.try_element_at(others, change_type), F.lit(presets.SHORT_DEFAULT)))


def change_label(change_type: Column, default: str = presets.CHANGE_LABEL_DEFAULT) -> Column:
    table = F.create_map(*[F.lit(x) for p in presets.CHANGE_LABELS.items() for x in p])
    return F.coalesce(F.try_element_at(table, change_type), X.truthy(change_type), F.lit(default))


def event_title(change_type: Column, after: Column) -> Column:
    """Change label, with its own title for a status that became delisted."""
    gone = (change_type == presets.STATUS) & (F.lower(after) == presets.DELISTED_STATUS)
    return F.when(gone, F.lit(presets.DELISTED_LABEL)).otherwise(change_label(change_type))


def section_change_label(change_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in presets.SECTION_CHANGE_LABELS.items() for x in p])
    return F.coalesce(F.try_element_at(table, change_type), change_type)


# ---- events from documents --------------------------------------------------------------------------------


def _entry_summary(doc: Column, profile: Profile) -> Column:
    return F.to_variant_object(
        F.struct(
            I.identity_of(doc, F.lit("unknown"), profile).alias("id"),
            I.name_of(doc, profile).alias("name"),
            V.at(doc, "manufacturer").alias("manufacturer"),
            V.at(doc, "status").alias("status"),
            V.at(doc, "bfarm_directory_url").alias("bfarm_directory_url"),
        )
    )


def described_changes(changes: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Change rows with what they need of their document `doc`, and without the document.

    Adds entity columns, the stored section context, and the description text of evidence changes.
    """
    doc, field = F.col("doc"), F.col("field")
    return changes.select(
        "__key",
        I.identity_of(doc, F.lit("unknown"), profile).alias("entity_id"),
        I.name_of(doc, profile).alias("entity_name"),
        V.at(doc, "manufacturer").alias("manufacturer"),
        V.at(doc, "bfarm_directory_url").alias("entity_url"),
        "change_type",
        "field",
        "before",
        "after",
        document_context(doc, field).alias("__stored"),
        F.when(field == profile.evidence_field, description_blob(doc)).alias("__blob"),
    )


def build_change_events(
    pairs: DataFrame,
    previous_ts: str,
    current_ts: str,
    detected_at: str,
    profile: Profile = DEFAULT,
    max_depth: int | None = None,
) -> DataFrame:
    """Events of two snapshots given as `(entity_id, before VARIANT, after VARIANT)` pairs.

    One row per added and removed entity and per field change that is a change in substance: moved
    text, misplaced text and re-ordered prices are dropped.  Word diffs are computed for text
    changes only.  The change rows are kept in a checkpoint, since several branches read them.
    """
    base = pairs.select(
        F.col("entity_id").alias("__key"),
        F.coalesce("after", "before").alias("doc"),
        "before",
        "after",
        F.col("before").isNull().alias("is_new"),
        F.col("after").isNull().alias("is_gone"),
    )
    whole = base.filter("is_new or is_gone").select(
        "__key",
        "doc",
        F.lit(presets.ENTRY_FIELD).alias("field"),
        F.when(F.col("is_gone"), _entry_summary(F.col("before"), profile)).alias("before"),
        F.when(F.col("is_new"), _entry_summary(F.col("after"), profile)).alias("after"),
        F.when(F.col("is_new"), F.lit(presets.ADDED)).otherwise(F.lit(presets.REMOVED)).alias("change_type"),
    )
    changed = document_changes(
        base.filter("not is_new and not is_gone").select("__key", "doc", "before", "after"), profile=profile, max_depth=max_depth
    )
    old, new = V.is_text(F.col("before")), V.is_text(F.col("after"))
    typed = changed.select("__key", "doc", "field", "before", "after", classify_change(F.col("field"), old, new, profile).alias("change_type"))
    described = described_changes(whole.unionByName(typed), profile)
    return enrich_events(drop_reordered_prices(cut_lineage(drop_misplaced_text(described, profile))), previous_ts, current_ts, detected_at, profile)


def drop_misplaced_text(changes: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Drop evidence changes that are boilerplate, or whose removed text is still among the descriptions."""
    evidence = F.col("field") == profile.evidence_field
    old, new = F.when(evidence, V.as_text(F.col("before"))), F.when(evidence, V.as_text(F.col("after")))
    kept = changes.filter(~(is_boilerplate(old) | is_boilerplate(new)))
    runs = kept.withColumn("__runs", W.word_runs(old, new))
    return runs.filter(~moved_text(W.removed_runs(F.col("__runs")), F.col("__blob"))).drop("__runs", "__blob")


def drop_reordered_prices(changes: DataFrame) -> DataFrame:
    """Drop price changes that differ in the order of their periods only.

    `price_visible` tells of the others whether the feed shows them; it is null for all other changes.
    """
    prices = changes.filter(F.col("change_type") == presets.PRICE)
    judged = P.price_document_verdicts(prices, ["__key", "field"]).filter("semantic")
    rest = changes.filter(F.col("change_type") != presets.PRICE)
    visible = F.lit(None).cast("boolean").alias("price_visible")
    return rest.select("*", visible).unionByName(judged.select(*rest.columns, F.col("visible").alias("price_visible")))


def enrich_events(changes: DataFrame, previous_ts: str, current_ts: str, detected_at: str, profile: Profile = DEFAULT) -> DataFrame:
    """Attach timestamps, context, word diff, kind, label and summary to described changes."""
    field, kind = F.col("field"), F.col("change_type")
    old, new = V.as_text(F.col("before")), V.as_text(F.col("after"))
    textual = kind == presets.TEXT
    diffed = changes.drop("__key").select(
        "*",
        W.word_diff(F.when(textual, old), F.when(textual, new)).alias("word_diff"),
        inferred_context(field, profile).alias("__inferred"),
        evidence_context(field, old, new, profile).alias("__evidence"),
    )
    inferred, evidence, stored = F.col("__inferred"), F.col("__evidence"), F.col("__stored")
    located = inferred.isNotNull() | evidence["display_path"].isNotNull() | stored.isNotNull()
    named = diffed.select(
        F.lit(detected_at).alias("detected_at"),
        "entity_id",
        "entity_name",
        "manufacturer",
        "entity_url",
        "change_type",
        "field",
        "before",
        "after",
        F.col("price_visible") if "price_visible" in diffed.columns else F.lit(None).cast("boolean").alias("price_visible"),
        F.lit(previous_ts).alias("previous_snapshot_ts"),
        F.lit(current_ts).alias("current_snapshot_ts"),
        "word_diff",
        F.when(textual, W.text_change_kind(F.coalesce("word_diff", F.array().cast(W.TOKENS)))).alias("text_change_kind"),
        merge_contexts(inferred, evidence, stored).alias("c"),
        located.alias("__located"),
    )
    section = F.coalesce("c.main_section", "c.section_title", "c.source_area_label")
    subsection = F.coalesce("c.question_label", "c.subsection_title", "c.section_field_label")
    place = F.coalesce(X.display_path(F.col("c.display_path")), context_label(section, subsection))
    label = F.when(F.col("__located"), place).otherwise(X.label_for(field, profile.field_labels))
    # Values are spelled out for the two kinds of summary that quote them.
    quoted = kind.isin(presets.PRICE, presets.STATUS)
    spell = lambda v: F.coalesce(V.as_text(v), F.when(V.is_blank(v), F.lit("None")), V.json_text(v))
    values = F.when(quoted, F.transform(F.array("before", "after"), spell))
    spelled = named.select("*", label.alias("field_label"), values[0].alias("__before"), values[1].alias("__after"))
    sentence = summary(kind, F.col("field_label"), F.col("text_change_kind"), F.col("__before"), F.col("__after"))
    return spelled.select("*", sentence.alias("summary"), "c.*").drop("c", "__located", "__before", "__after")


# ---- events as stored: old and new names, flags --------------------------------------------------------------


def unify_event_names(raw: DataFrame, event: str = "event") -> DataFrame:
    """One fixed schema from VARIANT events that use the current or the earlier key names.

    Names fall back on empty values, values by presence of their key (a present null stays null).
    """
    doc = F.col(event)
    members = V.as_object(doc)

    def by_presence(current: str, earlier: str) -> Column:
        return F.when(F.map_contains_key(members, F.lit(current)), V.member(doc, current)).otherwise(V.member(doc, earlier))

    def flag(name: str) -> Column:
        return (I.truthy_text(V.member(doc, name)).isNotNull()).alias(name)

    others = [c for c in raw.columns if c != event]
    legacy = presets.LEGACY_EVENT_COLUMNS
    plain = {
        "detected_at": "detected_at",
        "entity_id": legacy["entity_id"],
        "entity_name": legacy["entity_name"],
        "manufacturer": "manufacturer",
        "entity_url": legacy["entity_url"],
        "change_type": "change_type",
        "previous_snapshot_ts": legacy["previous_snapshot_ts"],
        "current_snapshot_ts": legacy["current_snapshot_ts"],
        "text_change_kind": "text_change_kind",
        "field_label": legacy["field_label"],
        "summary": legacy["summary"],
        **{c: ("field_label" if c == "section_field_label" else c) for c in CONTEXT},
    }
    field = F.coalesce(I.truthy_text(V.member(doc, legacy["field"])), I.truthy_text(V.member(doc, "field_name")), F.lit(""))
    return raw.select(
        *others,
        *[V.at(doc, source).alias(name) for name, source in plain.items()],
        field.alias("field"),
        by_presence(legacy["before"], "before_value").alias("before"),
        by_presence(legacy["after"], "after_value").alias("after"),
        V.member(doc, "word_diff").try_cast(W.TOKENS).alias("word_diff"),
        V.member(doc, "price_visible").try_cast("boolean").alias("price_visible"),
        *[flag(n) for n in FLAGS],
    )


def in_sequence(events: DataFrame) -> DataFrame:
    """The events with `seq`, the order the feed breaks ties by: time, then entity, field and values.

    The number comes from a range sort and a count per partition; equal events may swap places, which changes nothing.
    """
    order = [F.col(c) for c in ("detected_at", "entity_id", "entity_name", "field")]
    value = [F.xxhash64(event_value_text(events, c)) for c in ("before", "after")]
    placed = cut_lineage(events.withColumn("__value", F.struct(*value)).orderBy(*order, "__value"))
    return placed.withColumn("seq", F.monotonically_increasing_id()).drop("__value")


def legacy_events(events: DataFrame) -> DataFrame:
    """The same events under the column names of existing event files, earlier aliases included."""
    out = events
    for name, stored in {**presets.LEGACY_EVENT_COLUMNS}.items():
        if name in out.columns:
            out = out.withColumnRenamed(name, stored)
    names = presets.LEGACY_EVENT_COLUMNS
    out = out.withColumnRenamed("section_field_label", "field_label")
    return (
        out.withColumn("field_name", F.col(names["field"]))
        .withColumn("before_value", F.col(names["before"]))
        .withColumn("after_value", F.col(names["after"]))
    )


def event_value_text(events: DataFrame, name: str) -> Column:
    """Comparable display text of an event value, whether it is VARIANT or already a string."""
    if isinstance(events.schema[name].dataType, T.VariantType):
        return V.display_value(F.col(name))
    return X.clean_text(F.coalesce(F.col(name).cast("string"), F.lit("None")))


def event_value_missing(events: DataFrame, name: str) -> Column:
    if isinstance(events.schema[name].dataType, T.VariantType):
        return V.is_blank(F.col(name))
    return F.col(name).isNull()


def event_value_string(events: DataFrame, name: str) -> Column:
    """The value when it is a string, null otherwise."""
    if isinstance(events.schema[name].dataType, T.VariantType):
        return V.as_text(F.col(name))
    return F.col(name).cast("string")


def events_per_batch(events: DataFrame, batch: str) -> DataFrame:
    return events.groupBy(batch).agg(F.count(F.lit(1)).alias("changes_detected"))
