import random

from pyspark.sql import functions as F

from driftmark.operators import feed, moved

EVENT = "seq long, entity_id string, entity_name string, entity_url string, field string, before string, after string, change_type string, current_snapshot_ts string"
FIELD = "evidence_summary_text"


def words(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def entries_of(spark, rows):
    schema = "snapshot_id string, pos long, entity_id string, identifier string, entity_name string, entity_url string, text string, section string"
    doc = F.struct(F.struct(F.col("text").alias("a")).alias("descriptive_texts"), F.array(F.struct(F.col("section").alias("text"))).alias("structured_text_sections"))
    return spark.createDataFrame(rows, schema).select("snapshot_id", "pos", "entity_id", "identifier", "entity_name", "entity_url", F.to_variant_object(doc).alias("doc"))


def test_moved_events(spark):
    a, b, c = (" ".join(words(i, 60)) for i in range(3))
    long = " ".join("x" * 30 + str(i) for i in range(25))  # its first 240 characters hold seven words
    entries = entries_of(spark, [
        ("s1", 0, "id-1", None, "First", None, f"Intro {a.upper()} End", "none"),
        ("s1", 1, "id-2", "ext-2", "Second", "https://x/2", "other text", f"section with {b}"),
        ("s1", 2, "id-2", None, "Late twin", None, f"never seen {c}", ""),
        ("s2", 0, "id-1", None, "First", None, "all gone", ""),
        ("s2", 1, None, "", "", "", long, ""),
        ("s2", 2, "id-4", None, "Fourth", None, f"begins-{a}", f"<{long}>"),
        ("s2", 3, "id-5", None, "Fifth", None, " ".join(a.split()[:15]), ""),
    ])
    shots = spark.createDataFrame([("s1", "2026-06-01T08:00:00"), ("s2", "2026-06-02T08:00:00")], "snapshot_id string, at string").select("snapshot_id", F.to_timestamp("at").alias("taken_at"))
    one, two = "2026-06-01T08:00:01+00:00", "2026-06-03T08:00:00+00:00"
    rows = [
        (1, "ID-1", None, None, FIELD, f"{a} kept", "kept", "text_change", one),  # moved
        (2, "ID-1", None, None, FIELD, f"{a} kept", "kept", "text_change", two),  # gone by then
        (3, None, None, "HTTPS://X/2", FIELD, f"Label: {b} kept", "kept", "text_change", one),  # moved into a section
        (4, "id-2", None, None, FIELD, f"{c} kept", "kept", "text_change", one),  # the first of both entries decides
        (5, "EXT-2", None, None, FIELD, f"{b} kept", "kept", "text_change", one),  # by the other identifier
        (6, "id-1", None, None, "status", f"{a} kept", "kept", "text_change", one),  # another field
        (7, "id-1", None, None, FIELD, " ".join(a.split()[:15]) + " kept", "kept", "text_change", one),  # too short
        (8, "nobody", None, "", FIELD, f"{a} kept", "kept", "text_change", one),  # no entity
        (9, "id-4", None, None, FIELD, f"{a} kept", "kept", "text_change", two),  # from the middle of a word
        (10, "id-4", None, None, FIELD, f"{long} kept", "kept", "text_change", two),  # too few words for a shingle
        (11, "id-1", None, None, FIELD, None, a, "other_field_change", one),  # no text before
        (12, "id-1", None, None, FIELD, f"{a} kept", "kept", "text_change", "no time"),
        (13, "id-5", None, None, FIELD, f"{a} kept", "kept", "text_change", two),  # the shingle is there, the text is not
        (14, None, "FIRST", None, FIELD, f"{a} kept", f"kept {c}", "text_change", one),  # moved, other text added
    ]
    events = spark.createDataFrame(rows, EVENT)
    got = moved.mark_moved(events, shots, entries)
    assert {r.seq for r in got.collect() if r.moved} == {1, 3, 5, 9, 10, 14} and got.count() == len(rows)
    assert {r.seq for r in got.filter(feed.is_real(got)).collect()} == {2, 4, 6, 7, 8, 11, 12, 13}
    # Heavy keys split: the same rows.
    assert {r.seq for r in moved.moved_events(events, shots, entries, parts=20, min_rows=1).collect()} == {1, 3, 5, 9, 10, 14}
    assert moved.mark_moved(events.limit(0), shots, entries).count() == 0
    assert {r.moved for r in moved.mark_moved(events, shots, entries.limit(0)).collect()} == {False}
    assert {r.moved for r in moved.mark_moved(events, shots.limit(0), entries).collect()} == {False}


def test_no_text_holds_a_head_without_its_shingle(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        text = " ".join(words(rnd.random(), rnd.randint(12, 40)))
        at = rnd.randrange(len(text) - 80)
        rows.append((text, text[at : at + rnd.randint(60, 240)].strip()))
    df = spark.createDataFrame(rows, "blob string, head string").filter(F.contains("blob", F.col("head")))
    wrong = df.filter(moved.probe(F.col("head")).isNotNull() & ~F.array_contains(moved.shingles(F.col("blob")), moved.probe(F.col("head"))))
    assert df.count() == 300 and df.filter(moved.probe(F.col("head")).isNotNull()).count() > 100 and wrong.count() == 0
