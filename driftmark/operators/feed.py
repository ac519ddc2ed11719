"""The change feed: which events are shown, once each, grouped per entity and local day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import text as X
from driftmark.functions import times as D
from driftmark.operators import events as E
from driftmark.operators import textdiff as W
from driftmark.operators.skew import lookup_join
from driftmark.presets import DEFAULT, Profile


def _flag(events: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in events.columns else F.lit(False)


def metadata_field(field: Column) -> Column:
    """Paths that only say when or where data was read."""
    name = F.lower(field)
    return (
        name.isin(*presets.METADATA_FIELDS)
        | (name == presets.METADATA_PREFIX)
        | F.startswith(name, F.lit(presets.METADATA_PREFIX + "."))
        | X.contains_any(name, presets.METADATA_MARKERS)
    )


def is_metadata(events: DataFrame, profile: Profile = DEFAULT) -> Column:
    """Metadata path, misplaced text, or text that moved (column `moved`, when the events carry it)."""
    misplaced = E.misplaced_text(
        F.col("field"), E.event_value_string(events, "before"), E.event_value_string(events, "after"), profile
    )
    return metadata_field(F.col("field")) | misplaced | _flag(events, "moved")


def is_notifiable(events: DataFrame, include_simulated: bool = False) -> Column:
    """Events a digest counts: no simulation, no development clean-up, no first-time source notice."""
    name = F.lower(F.col("field"))
    first_notice = E.event_value_missing(events, "before") & (
        (name == presets.NOTICE_FIELD) | F.contains(name, F.lit(presets.CHECKED_SOURCES))
    )
    internal = _flag(events, "development") | _flag(events, "is_development") | _flag(events, "baseline_cleanup")
    simulated = F.lit(False) if include_simulated else _flag(events, "simulated")
    return ~(simulated | internal | first_notice)


def is_real(events: DataFrame, profile: Profile = DEFAULT) -> Column:
    """Events the feed shows: notifiable and not metadata."""
    return is_notifiable(events) & ~is_metadata(events, profile)


def in_local_dates(events: DataFrame, start: str, end: str, timezone: str = presets.DISPLAY_TIMEZONE) -> DataFrame:
    """Events whose local date lies in the closed range; unparsable times are dropped."""
    day = D.local_date(D.parse_time(F.col("detected_at")), timezone)
    return events.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def has_visible_change(events: DataFrame) -> Column:
    """Price events follow their verdict (column `price_visible`), others, and price events stored without one, their normalised values."""
    differs = E.event_value_text(events, "before") != E.event_value_text(events, "after")
    verdict = F.col("price_visible") if "price_visible" in events.columns else F.lit(None).cast("boolean")
    return F.when(F.col("change_type") == presets.PRICE, F.coalesce(verdict, differs)).otherwise(differs)


def localization_score(events: DataFrame, profile: Profile = DEFAULT) -> Column:
    """How well an event says where it happened; decides between duplicates."""

    def has(*names: str) -> Column:
        hit = F.lit(False)
        for n in names:
            if n in events.columns:
                hit = hit | (F.coalesce(F.col(n), F.lit("")) != "")
        return hit

    def points(hit: Column, n: int) -> Column:
        return F.when(hit, F.lit(n)).otherwise(F.lit(0))

    field = F.col("field")
    low = (F.col("localization_confidence") == "low") if "localization_confidence" in events.columns else F.lit(False)
    misplaced = E.misplaced_text(field, E.event_value_string(events, "before"), E.event_value_string(events, "after"), profile)
    return (
        points(F.startswith(field, F.lit(presets.DESCRIPTION_PREFIX)), 30)
        + points(has("display_path"), 20)
        + points(has("question_label", "subsection_title"), 15)
        + points(has("main_section", "section_title"), 10)
        + points(field == profile.evidence_field, 5)
        + points(F.coalesce(low, F.lit(False)), -20)
        + points(misplaced, -100)
    )


def signature(events: DataFrame) -> Column:
    """Identity of what happened: the changed phrase of a text, else field and normalised values."""
    phrase = W.phrase_signature(F.col("word_diff")) if "word_diff" in events.columns else F.lit(None).cast("string")
    empty = F.lit("")
    text_only = F.struct(F.lit(presets.TEXT).alias("s1"), phrase.alias("s2"), empty.alias("s3"))
    full = F.struct(
        F.col("field").alias("s1"), E.event_value_text(events, "before").alias("s2"), E.event_value_text(events, "after").alias("s3")
    )
    return F.when((F.col("change_type") == presets.TEXT) & phrase.isNotNull(), text_only).otherwise(full)


def entity_key(events: DataFrame) -> Column:
    return F.lower(
        F.coalesce(
            X.truthy(F.col("entity_id").cast("string")), X.truthy(F.col("entity_name")), X.truthy(F.col("entity_url")), F.lit("unknown")
        )
    )


def feed_label(events: DataFrame) -> Column:
    """Label events are ordered by: their own label or path, else the label of the field."""
    own = [
        X.display_path(X.truthy(F.col(n))) for n in ("field_label", "display_path") if n in events.columns
    ]
    return F.coalesce(*own, X.label_for(F.col("field"), presets.FEED_FIELD_LABELS))


def keyed_events(events: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Events with `entity_key`, `local_date`, parsed `detected`, `label`, `score`; `seq` is their order."""
    detected = D.parse_time(F.col("detected_at"))
    return (
        events.withColumn("entity_key", entity_key(events))
        .withColumn("detected", detected)
        .withColumn("local_date", D.local_date(detected, profile.timezone))
        .withColumn("label", feed_label(events))
        .withColumn("score", localization_score(events, profile))
    )


def deduplicate(events: DataFrame, group: Sequence[str] = ("entity_key", "local_date")) -> DataFrame:
    """Per group and signature the best localised event, the earliest (`seq`) on a tie.

    An aggregate with map-side combine: copies of one event collapse where they are read.
    """
    rest = F.struct(*[c for c in events.columns if c not in group])
    best = (
        events.withColumn("__sig", signature(events))
        .groupBy(*group, "__sig")
        .agg(F.max_by(rest, F.struct(F.col("score"), (-F.col("seq")).alias("n"))).alias("__e"))
    )
    return best.select(*group, "__e.*")


def feed_events(events: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """The rows of the feed: visible, non-metadata, deduplicated events of every group."""
    shown = events.filter(~is_metadata(events, profile) & has_visible_change(events))
    return deduplicate(keyed_events(shown, profile))


def feed_groups(events: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """One header row per entity and local day.

    The events of a group stay rows of `feed_events` (same keys), so a group of any size is
    aggregated in pieces and never gathered.
    """
    rows = feed_events(events, profile)
    place = F.struct(F.coalesce("detected", F.lit("0001-01-01").cast("timestamp")).alias("t"), F.col("label"), (-F.col("seq")).alias("s"))

    def first_present(name: str) -> Column:
        value = X.truthy(F.col(name).cast("string"))
        return F.max_by(value, F.when(value.isNotNull(), place))

    def stamp(name: str, latest: bool) -> Column:
        parsed = D.parse_time(F.col(name))
        rank = F.when(parsed.isNotNull(), F.struct(parsed.alias("t"), (-F.col("seq") if latest else F.col("seq")).alias("s")))
        return (F.max_by if latest else F.min_by)(F.col(name), rank)

    groups = rows.groupBy("entity_key", "local_date").agg(
        F.coalesce(X.truthy(F.max_by("entity_name", place)), F.lit(presets.UNKNOWN_ENTITY)).alias("entity_name"),
        first_present("manufacturer").alias("manufacturer"),
        first_present("entity_url").alias("entity_url"),
        stamp("detected_at", True).alias("detected_at"),
        stamp("previous_snapshot_ts", False).alias("previous_snapshot_ts"),
        stamp("current_snapshot_ts", True).alias("current_snapshot_ts"),
        F.count(F.lit(1)).alias("adjustments"),
    )
    return groups.join(update_notices(events, profile), ["entity_key", "local_date"], "left")


def update_notices(events: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Per group the formatted time of its first source-update event among all events given."""
    notices = events.filter(F.col("field") == presets.NOTICE_TIME_FIELD)
    value = E.event_value_string(notices, "after")
    first = keyed_events(notices.withColumn("__value", value), profile).filter("__value is not null").groupBy("entity_key", "local_date").agg(
        F.min_by("__value", F.col("seq")).alias("__value")
    )
    shown = D.format_time(D.parse_time(F.col("__value")), profile.timezone)
    return first.select("entity_key", "local_date", shown.alias("source_update_notice"))


def in_feed_order(groups: DataFrame) -> DataFrame:
    """Latest group first; a range sort, so no task sees more than its share."""
    return groups.orderBy(F.desc_nulls_last(D.parse_time(F.col("detected_at"))), "entity_key", "local_date")


def in_event_order(rows: DataFrame) -> DataFrame:
    """Feed rows in display order inside their groups; the sort key is unique, so large groups split."""
    return rows.orderBy("entity_key", "local_date", F.desc_nulls_last("detected"), F.desc("label"), "seq")


def feed_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("affected_entities"),
        F.coalesce(F.sum("adjustments"), F.lit(0)).alias("adjustments"),
        F.max(D.parse_time(F.col("detected_at"))).alias("latest_change"),
    )


def latest_scan(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """Time of the latest scan: the newest snapshot, the scan history when there is no snapshot."""
    newest = snapshots.agg(F.max("created_at").alias("t")).select(F.lit(0).alias("p"), "t")
    logged = history.agg(F.max("scan_timestamp").alias("t")).select(F.lit(1).alias("p"), "t")
    both = newest.unionByName(logged).filter("t is not null")
    return both.agg(F.min_by("t", "p").alias("latest_scan"))


def match_entities(events: DataFrame, event_id: str, event_keys: Sequence[str], entries: DataFrame, entry_id: str, entry_keys: Sequence[str], position: str) -> DataFrame:
    """Event to the first entry that shares any key with it, ignoring case.

    Both key sets are exploded and joined on the key itself; a key used by many events is spread.
    """

    def keys(names: Sequence[str]) -> Column:
        return F.explode(F.array_distinct(F.filter(F.array(*[F.lower(F.col(n).cast("string")) for n in names]), lambda k: k.isNotNull() & (k != ""))))

    owners = entries.select(keys(entry_keys).alias("__key"), F.struct(position, entry_id).alias("owner")).groupBy("__key").agg(
        F.min("owner").alias("owner")
    )
    probes = events.select(event_id, keys(event_keys).alias("__key"))
    hits = lookup_join(probes, owners, ["__key"], "left", salt_by=[event_id])
    return hits.groupBy(event_id).agg(F.min("owner").alias("owner")).select(event_id, F.col(f"owner.{entry_id}").alias(entry_id))


def changed_targets(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct entities with a notifiable event and a URL; the last event decides name and URL."""
    notable = events.filter(is_notifiable(events) & (F.coalesce(F.col("entity_id").cast("string"), F.lit("")) != ""))
    known = entries.select("entity_id", F.col("entity_name").alias("__name"), F.col("entity_url").alias("__url"))
    # Whether the entry knows a URL is the same for all events of an entity, so the last event is
    # chosen among those with one of their own first, among all of them only if the entry has one.
    own_url = X.truthy(F.col("entity_url"))
    last = notable.groupBy("entity_id").agg(
        F.max_by(F.struct("entity_name", "entity_url"), F.col("seq")).alias("any"),
        F.max_by(F.struct("entity_name", "entity_url"), F.when(own_url.isNotNull(), F.col("seq"))).alias("own"),
    )
    joined = last.join(known, "entity_id", "left")
    chosen = F.when(X.truthy(F.col("__url")).isNotNull(), F.col("any")).otherwise(F.col("own"))
    return joined.withColumn("e", chosen).select(
        "entity_id",
        F.coalesce(X.truthy(F.col("e.entity_name")), X.truthy(F.col("__name")), F.col("entity_id").cast("string")).alias("entity_name"),
        F.coalesce(X.truthy(F.col("e.entity_url")), X.truthy(F.col("__url"))).alias("entity_url"),
    ).filter("entity_url is not null")
