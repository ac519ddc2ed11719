"""Moved text on read: which stored events only tell that evidence text went over into the descriptions.

An event's entity is looked up in the snapshot nearest to the event's time, by any key they share. Whether a removed
run of words still stands among that entity's descriptions is asked of an index of word shingles of the
descriptions: a run's shingle is joined to the index, and descriptions travel to the runs that hit it only, where
the text itself decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import text as X
from driftmark.functions import times as D
from driftmark.functions import variant as V
from driftmark.operators import events as E
from driftmark.operators import textdiff as W
from driftmark.operators.feed import match_entities
from driftmark.operators.skew import lookup_join
from driftmark.operators.versions import nearest_version
from driftmark.presets import DEFAULT, Profile
from driftmark.session import cut_lineage

SHINGLE = 8  # words


def shingles(blob: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words of a normalised text."""

    def of(words: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))

    return V.let(F.split(blob, " "), of)  # split once, not once per shingle


def probe(head: Column, n: int = SHINGLE) -> Column:
    """The hash that a text holds for sure if it holds `head`; null if head has too few words.

    A text may hold head from the middle of a word to the middle of another, so the first and last words don't count.
    """
    words = F.split(head, " ")
    return F.when(F.size(words) >= n + 2, F.xxhash64(F.array_join(F.slice(words, 2, n), " ")))


def removed_heads(events: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """`(seq, head)`: the beginnings of the removed runs of evidence events that have enough words to be followed."""
    texts = events.filter(F.col("field") == profile.evidence_field).select(
        "seq", E.event_value_string(events, "before").alias("__old"), E.event_value_string(events, "after").alias("__new")
    ).filter("__old is not null and __new is not null")
    runs = texts.select("seq", W.word_runs(F.col("__old"), F.col("__new")).alias("__runs")).select("seq", F.explode(W.removed_runs(F.col("__runs"))).alias("run"))
    runs = runs.select("seq", X.normalize_text(X.strip_leading_label(F.col("run"))).alias("run"))
    long = (F.col("run") != "") & (F.size(F.split("run", " ")) >= presets.MOVED_MIN_WORDS)
    return runs.filter(long).select("seq", F.substring("run", 1, presets.MOVED_PREFIX_CHARS).alias("head")).distinct()


def entries_at(events: DataFrame, snapshots: DataFrame, entries: DataFrame, **skew) -> DataFrame:
    """`(seq, entry)`: the first entry, in the snapshot nearest to the event's, that shares a key with the event.

    `entry` names an entry `(snapshot_id, pos)`. Events without a readable time or a known key are left out.
    """
    timed = events.select("seq", "entity_id", "entity_name", "entity_url", D.parse_time(F.col("current_snapshot_ts")).alias("__at"))
    placed = nearest_version(timed, "__at", snapshots, "taken_at", "snapshot_id", **skew).filter("snapshot_id is not null")

    def within(*names: str) -> list[Column]:
        """Keys that hold in one snapshot only."""
        return [F.concat(F.col("snapshot_id"), F.lit("\x1f"), X.truthy(F.col(n).cast("string"))).alias(f"__key_{i}") for i, n in enumerate(names)]

    own = placed.select("seq", *within("entity_id", "entity_name", "entity_url"))
    named = entries.select("pos", F.concat_ws("\x1f", "snapshot_id", F.col("pos").cast("string")).alias("entry"), *within("entity_id", "identifier", "entity_name", "entity_url"))
    found = match_entities(own, "seq", [f"__key_{i}" for i in range(3)], named, "entry", [f"__key_{i}" for i in range(4)], "pos")
    return found.filter("entry is not null")


def moved_events(events: DataFrame, snapshots: DataFrame, entries: DataFrame, profile: Profile = DEFAULT, **skew) -> DataFrame:
    """`seq` of the events whose removed text moved.

    snapshots is `(snapshot_id, taken_at)`; entries `(snapshot_id, pos, entity_id, identifier, entity_name, entity_url, doc VARIANT)`.
    """
    heads = cut_lineage(removed_heads(events, profile))
    asked = events.join(heads.select("seq").distinct(), "seq", "left_semi")
    owners = cut_lineage(entries_at(asked, snapshots, entries, **skew))
    name = F.concat_ws("\x1f", "snapshot_id", F.col("pos").cast("string")).alias("entry")
    blobs = entries.select(name, E.description_blob(F.col("doc")).alias("blob")).join(owners.select("entry").distinct(), "entry", "left_semi")
    index = blobs.select("entry", F.explode(shingles(F.col("blob"))).alias("h"), F.lit(True).alias("known"))
    probes = heads.join(owners, "seq").withColumn("h", probe(F.col("head")))
    hits = lookup_join(probes.filter("h is not null"), index, ["entry", "h"], "inner", salt_by=["seq", "head"], **skew)
    likely = hits.select("seq", "entry", "head").unionByName(probes.filter("h is null").select("seq", "entry", "head"))
    judged = lookup_join(likely, blobs, ["entry"], "inner", salt_by=["seq", "head"], **skew)
    return judged.filter(F.contains("blob", F.col("head"))).select("seq").distinct()


def mark_moved(events: DataFrame, snapshots: DataFrame, entries: DataFrame, profile: Profile = DEFAULT, **skew) -> DataFrame:
    """Events with the column `moved`, which `feed.is_metadata` reads; seq has to be unique."""
    found = moved_events(events, snapshots, entries, profile, **skew).withColumn("moved", F.lit(True))
    return events.join(found, "seq", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
