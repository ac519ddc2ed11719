"""Assembly of resource bundles, page sections, stores, scans and the streaming feed."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import assembly as A
from driftmark.operators import digest as N
from driftmark.operators import sections as S
from driftmark.operators import versions as G
from driftmark.plans import monitor
from driftmark.sources import bundles, event_store, logs, sitemap, snapshots
from driftmark.streaming import change_feed

KINDS = ("health_apps", "catalog_entries", "manufacturers", "modules", "prescription_units", "questionnaires", "questionnaire_responses")


@pytest.fixture(scope="module")
def landed(spark, fixtures):
    return {k: bundles.read_bundles(spark, f"{fixtures}/bundles/{k}_*.json").persist() for k in KINDS}


@pytest.fixture(scope="module")
def tables(spark, landed, fixtures):
    directory = sitemap.read_sitemap(spark, f"{fixtures}/sitemap.xml")
    return A.assemble(landed, directory)


def test_bundles_skip_malformed_entries(landed):
    rows = landed["health_apps"].orderBy("pos").select(V.at(F.col("resource"), "id")).collect()
    assert [r[0] for r in rows] == ["a1", "a2", "a3"]


def test_sitemap(spark, fixtures):
    rows = sitemap.read_sitemap(spark, f"{fixtures}/sitemap.xml").orderBy("entity_id").collect()
    assert [(r.entity_id, r.entity_url[-6:]) for r in rows] == [("00508", "/00508"), ("00777", "/00777")]


def test_records(tables):
    rows = tables["records"].select("entity_id", "name", "manufacturer", "status", "entity_url").orderBy("entity_id").collect()
    base = "https://diga.bfarm.de/de/verzeichnis/"
    assert [tuple(r) for r in rows] == [
        ("00508", "App Eins", "Hersteller GmbH", "listed", base + "00508"),
        ("a2", "App Zwei", None, "removed", base + "a2"),
        ("a3", "App Drei", None, "provisional", base + "a3"),
    ]


def test_record_children(tables):
    texts = {(r.entity_id, r.key): r.text for r in tables["texts"].collect()}
    assert texts == {
        ("00508", "catalog_entry.note.0.text"): "Hinweis zum Eintrag und das ist ein ausreichend langer Text.",
        ("00508", "questionnaire.Bitte Steckbrief der DiGA"): "Kurzer Steckbrief",
        ("00508", "questionnaire.Nachweis der Studie"): "True 7 Anzeige K",
        ("00508", "questionnaire.9"): "ohne Frage",
    }
    assert [r.part for r in tables["evidence"].collect()] == ["Nachweis der Studie: True 7 Anzeige K"]
    history = tables["history"].orderBy("position").collect()
    assert [(h.title, h.text) for h in history] == [("Aufnahme", "2025-01-02 Aufnahme erste Aufnahme"), ("chg", "chg")]
    prices = tables["prices"].orderBy("entity_id", "module_pos").collect()
    assert [(p.entity_id, p.title, p.text) for p in prices] == [
        ("00508", "Einheit u1", ["Der Preis beträgt 499,00 €", "EUR"]), ("00508", "Einheit u1", ["Der Preis beträgt 499,00 €", "EUR"]), ("a3", "Einheit u2", None),
    ]
    found = {(r.entity_id, r.indication) for r in tables["indications"].collect()}
    assert found == {("00508", "F32.0 Leichte Episode"), ("a3", "M23.2")}
    updates = {r.entity_id: (r.last_updated_at, r.checked_sources) for r in tables["updates"].collect()}
    assert updates["00508"] == ("2026-05-05T06:00:00Z", 7)
    assert updates["a2"] == ("2026-05-01T09:30:00Z", 1)


def test_registry_documents(spark, landed, fixtures):
    directory = sitemap.read_sitemap(spark, f"{fixtures}/sitemap.xml")
    docs = {r.entity_id: json.loads(r.j) for r in A.registry_documents(landed, directory).select("entity_id", F.to_json("doc").alias("j")).collect()}
    assert sorted(docs) == ["00508", "00777", "a2", "a3"]
    full = docs["00508"]
    assert full["evidence_summary_text"] == "Nachweis der Studie: True 7 Anzeige K"
    assert full["raw_public_fhir"]["module_ids"] == ["m1", "m2"] and full["raw_public_fhir"]["prescription_unit_ids"] == ["u1", "u1"]
    assert [s["field_path"] for s in full["structured_text_sections"]] == sorted(s["field_path"] for s in full["structured_text_sections"])
    assert full["source_update_notice"]["notice_text"] == "Zuletzt aktualisiert am 05.05.2026 um 08:00"
    assert docs["00777"]["status"] == "unknown" and docs["00777"]["descriptive_texts"] == {}


# ---- sections ------------------------------------------------------------------------------------------

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><div>Menü</div><main>
<h1>Titel</h1><p>Einleitung steht hier.</p>
<h2>Angaben</h2><p>Erster <b>fetter</b> Text.</p><p>Zweiter Text.</p><ul><li>Punkt eins.</li><li>Suche</li></ul>
<h3>Details</h3><dl><dt>Hersteller</dt><dd>Firma GmbH</dd><dt>Land</dt><dd>DE</dd></dl>
<p><strong>Altersgruppe</strong></p><p>ab 18 Jahren</p>
<h2>Hilfe &amp; Support</h2><p>Nicht dabei.</p>
<h2>Doppelt</h2><p>Gleich.</p><h2>Doppelt</h2><p>Gleich.</p><script>var p = "<p>no</p>";</script>
</main></body></html>"""


def test_extract_sections(spark):
    pages = spark.createDataFrame([("00508", PAGE), ("leer", ""), ("ohne", None)], "id string, html string")
    rows = S.extract_sections(pages, "id", "html").orderBy("id", "position").collect()
    got = [(" > ".join(r.path), r.content_type, r.content) for r in rows]
    assert got == [
        ("Titel", "section", "Einleitung steht hier."),
        ("Angaben", "section", "Erster fetter Text. fetter Zweiter Text. Punkt eins."),
        ("Angaben > Details > Hersteller", "field_value", "Firma GmbH"),
        ("Angaben > Details > Land", "field_value", "DE"),
        ("Angaben > Details > Altersgruppe", "field_value", "ab 18 Jahren"),
        ("Angaben", "section", "Nicht dabei."),
        ("Doppelt", "section", "Gleich."),
    ]
    assert rows[2].stable_key.startswith("00508:angaben-details-hersteller-") and rows[2].stable_key.endswith(":field_value")
    examples = S.field_examples(S.extract_sections(pages, "id", "html"), ["id", "position"], 2).collect()
    assert [e.content for e in examples] == ["Firma GmbH", "DE"]


HARD_PAGES = {
    "entities": ("<h1>Titel</h1><p>R&amp;D &#228;&#xE9; &uuml; &unknown; a &lt;b&gt; 3 < 4</p>", [("Titel", "section", "R&D äé ü &unknown; a <b> 3 < 4")]),
    "roles": (
        '<body><div role="heading" aria-level="2">Oben</div><span role=heading>Unten</span><p>Text eins.</p></body>',
        [("Oben > Unten", "section", "Text eins.")],
    ),
    "labels": (
        "<h2>Aa</h2><h3>Bb</h3><p><b>Kurz</b></p><p><b>Lang</b></p><p>Wert.</p><p>Danach.</p><dl><dt>C</dt><dt>Feld</dt><dd>Inhalt</dd></dl>",
        [("Aa > Bb > Lang", "field_value", "Wert."), ("Aa", "section", "Danach."), ("Aa > Feld", "field_value", "Inhalt")],
    ),
    "sentence": (
        "<h2>Aa</h2><p>Vorab.</p><p><b>Ein Satz.<br></p><p>Wert.</p><p>Danach.</p>",
        [("Aa", "section", "Vorab. Ein Satz."), ("Aa > Ein Satz.", "field_value", "Wert."), ("Aa", "section", "Danach.")],
    ),
    "nested": (
        "<h2>Liste</h2><div>nicht dabei</div><ul><li>eins<ul><li>zwei</li></ul>drei</li></ul><div>nicht dabei</div>",
        [("Liste", "section", "eins zwei drei")],
    ),
    "restart": (
        "<h1>T1</h1><h2>Unter</h2><p>aa</p><h1>T2</h1><p>bb</p><p>cc</p>",
        [("Unter", "section", "aa"), ("T2", "section", "bb cc")],
    ),
    "unseen": ("<h1>Titel</h1><!-- <p>nein</p> --><script>'<p>nein</p>'</script><p>ja</p><p>x</p><p>Suche</p>", [("Titel", "section", "ja")]),
    "open": ("<h1>Titel</h1>" + "<p" * 2000 + "<p>eins<p>zwei<br>drei", [("Titel", "section", "eins zwei drei")]),
    "long": ("<h1>Titel</h1><p>" + "wort " * 60_000 + "</p>", [("Titel", "section", ("wort " * 60_000).strip())]),
    "plain": ("nur Text", []),
    "no title": ("<p>Der Ersatztitel ist kein Inhaltspfad.</p>", []),
    "blank": (" \n ", []),
}


def test_extract_sections_of_hard_pages(spark):
    rows = [(k, html, 1) for k, (html, _) in HARD_PAGES.items() for _ in range(2)]  # every row twice
    pages = spark.createDataFrame([*rows, (None, "<h1>Titel</h1><p>ohne Schlüssel</p>", 1), ("leer", None, 1)], "id string, html string, pos int")
    got: dict = {}
    for r in S.extract_sections(pages, "id", "html").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((" > ".join(r.path), r.content_type, r.content))
    assert got.pop(None) == [("Titel", "section", "ohne Schlüssel")]
    assert got == {k: want for k, (_, want) in HARD_PAGES.items() if want}
    assert S.extract_sections(pages.limit(0), "id", "html").collect() == []


def test_extract_sections_shuffles_once_without_python(spark):
    pages = spark.createDataFrame([("a", PAGE)], "id string, html string")
    plan = S.extract_sections(pages, "id", "html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "InPandas" not in plan


def matcher_changes(before, after):
    before, after = sorted(before), sorted(after)
    out = []
    for op, i, k, j, n in difflib.SequenceMatcher(a=before, b=after, autojunk=False).get_opcodes():
        if op == "replace" and k - i == n - j:
            out += [("changed_text", b, a) for b, a in zip(before[i:k], after[j:n])]
        elif op != "equal":
            out += [("removed_section", b, "") for b in before[i:k]] + [("added_section", "", a) for a in after[j:n]]
    return sorted(out)


def test_section_changes_read_their_sections_once(spark):
    """Finding the sections is the long work; counting their keys does not do it again."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def keyed(stable_key):
        read.add(1)
        return stable_key

    rows = [("a", f"k{i % 3}", f"text {i}", "section", "p") for i in range(30)]
    sides = [spark.createDataFrame(r, "e string, stable_key string, content string, content_type string, display_path string") for r in (rows[:25], rows[5:])]
    found = S.section_changes(*[df.withColumn("stable_key", keyed("stable_key")) for df in sides], "e").collect()
    assert {r.before for r in found} - {""} == {f"text {i}" for i in range(5)} and read.value == 50


@pytest.mark.parametrize("skew", [{}, {"min_rows": 5, "parts": 1000}])
def test_section_changes_equal_the_sequence_matcher(spark, skew):
    rnd = random.Random(9)
    cases = [[rnd.sample(range(40), rnd.randint(0, 14)) for _ in range(2)] for _ in range(60)]
    cases.append([rnd.sample(range(900), 500), rnd.sample(range(900), 500)])
    rows = [(k, side, f"c{v:03d}") for k, pair in enumerate(cases) for side, values in enumerate(pair) for v in values]
    df = spark.createDataFrame(rows, "e int, side int, content string").select(
        "e", "side", "content", F.lit("key").alias("stable_key"), F.lit("section").alias("content_type"), F.array(F.lit("A")).alias("path")
    )
    sides = [S.diffable_sections(df.filter(F.col("side") == n), "e") for n in (0, 1)]
    got = {}
    for r in S.section_changes(*sides, "e", **skew).collect():
        got.setdefault(r.e, []).append((r.change_type, r.before, r.after))
    for k, (b, a) in enumerate(cases):
        assert sorted(got.get(k, [])) == matcher_changes([f"c{v:03d}" for v in b], [f"c{v:03d}" for v in a])


def test_copies_and_report(spark):
    rows = [(1, 0, "x")] * 3 + [(1, 1, "x")] + [(2, 0, "a"), (2, 1, "a")] + [(3, 1, "n")]
    df = spark.createDataFrame(rows, "e int, side int, content string").select(
        "e", "side", "content", F.lit("key").alias("stable_key"), F.lit("field_value").alias("content_type"), F.array(F.lit("A")).alias("path")
    )
    before, after = [S.diffable_sections(df.filter(F.col("side") == n), "e") for n in (0, 1)]
    changes = S.with_excerpts(S.section_changes(before, after, "e"))
    assert sorted((r.e, r.change_type, r.diff_excerpt) for r in changes.collect()) == [
        (1, "removed_section", "x"), (1, "removed_section", "x"), (3, "added_section", "n"),
    ]
    comparable = S.comparable_entities(before, after, "e")
    inside = changes.join(comparable, "e", "left_semi")
    assert [tuple(r) for r in S.report_totals(comparable, inside, "e").collect()] == [(2, 1, 2)]
    assert S.report_totals(comparable.limit(0), inside, "e").count() == 0
    low = spark.createDataFrame([("", "LOW"), ("visible_directory", "high"), ("other", None)], "k string, c string")
    assert [r[0] for r in low.select(S.is_low_confidence(F.col("k"), F.col("c"))).collect()] == [True, False, True]


# ---- scans ------------------------------------------------------------------------------------------------


def entries(spark, values):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "entity_id string, j string")
    return df.select("entity_id", F.parse_json("j").alias("doc"))


def test_scans(spark, tmp_path):
    root = str(tmp_path)
    first = {"1": {"id": "1", "status": "a"}, "2": {"id": "2", "name": "n"}, "3": {"id": "3"}}
    second = {"1": {"id": "1", "status": "b"}, "2": {"id": "2", "name": "n"}, "4": {"id": "4"}}
    assert monitor.diff_latest(spark, root) is None
    base = monitor.run_scan(entries(spark, first), root, "s1", "2026-06-01T00:00:00Z", "2026-06-01T00:00:01Z")
    assert (base.previous_id, base.entities, base.events) == (None, 3, 0)
    for _ in range(2):  # the same scan again replaces what it wrote
        scan = monitor.run_scan(entries(spark, second), root, "s2", "2026-06-02T00:00:00Z", "2026-06-02T00:00:01Z")
        assert (scan.previous_id, scan.entities, scan.events) == ("s1", 3, 3)
    sample = monitor.run_scan(entries(spark, first), root, "s3", "2026-06-03T00:00:00Z", "2026-06-03T00:00:01Z", mode="sample")
    assert sample.events == 0
    assert monitor.diff_latest(spark, root) == ("s2", "s3")
    events = event_store.read_events(spark, root)
    assert {(r.entity_id, r.change_type) for r in events.collect()} == {("1", "status_change"), ("3", "removed_diga"), ("4", "new_diga")}
    assert [(r.batch_id, r.event_count) for r in event_store.read_batches(spark, root).collect()] == [("s2", 3)]
    history = monitor.scan_history(spark, root).orderBy("scan_timestamp").collect()
    assert [(h.number_of_entities, h.changes_detected) for h in history] == [(3, 0), (3, 3), (3, 0)]
    lines = N.digest_lines(events.withColumn("seq", F.xxhash64("entity_id"))).collect()
    assert len(lines) == 3 and all(x.description for x in lines)
    assert snapshots.list_snapshots(spark, root).count() == 3
    assert [r.snapshot_id for r in G.latest_snapshots(snapshots.list_snapshots(spark, root)).collect()] == ["s3", "s2"]


def test_scans_log_their_digests(spark, tmp_path):
    root, told = str(tmp_path / "told"), []
    first = {"1": {"id": "1", "status": "a"}, "2": {"id": "2", "status": "a"}}
    second = {"1": {"id": "1", "status": "b"}, "3": {"id": "3", "status": "a"}}

    def deliver(numbers, lines):
        told.append((numbers.number_of_changes, numbers.subject, lines.count()))
        if len(told) == 2:
            raise OSError("no route to the mail host")

    sent = monitor.Digest("team@example.org", deliver)
    plan = [(first, "full", sent), (second, "full", sent), (first, "full", sent), (second, "sample", sent), (first, "full", monitor.Digest())]
    for n, (rows, mode, digest) in enumerate(plan):
        monitor.run_scan(entries(spark, rows), root, f"s{n}", f"2026-06-0{n + 1}T00:00:00Z", f"2026-06-0{n + 1}T00:00:01Z", mode=mode, digest=digest)
    logged = {r.batch_id: (r.number_of_changes, r.status, r.error_message, r.recipient) for r in monitor.digest_log(spark, root).collect()}
    none, dry = "Keine echten Änderungen erkannt.", "Dry-run: email not sent."
    assert logged == {
        "s0": (0, "skipped", none, "team@example.org"),
        "s1": (3, "sent", None, "team@example.org"),
        "s2": (3, "failed", "no route to the mail host", "team@example.org"),
        "s3": (0, "skipped", none, "team@example.org"),
        "s4": (3, "skipped", dry, ""),
    }
    assert told == [(3, "3 Änderung(en) erkannt", 3)] * 2


def test_missing_logs_are_empty(spark, tmp_path, fixtures):
    assert monitor.scan_history(spark, str(tmp_path / "none")).count() == 0
    rows = logs.read_history_file(spark, f"{fixtures}/scan_history.json", "number_of_diga").collect()
    assert [(r.number_of_entities, r.changes_detected) for r in rows] == [(78, 0), (78, 5)]


# ---- streaming --------------------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(n, rnd.choice([0, 0, 0, 1, 2, 3, 4]), n * 10, f"v{rnd.randint(0, 5)}") for n in range(600)]
    landing = str(tmp_path / "landing")
    for part in range(6):
        cut = spark.createDataFrame(rows[part * 100 : part * 100 + 100], "id long, entity long, at long, value string")
        cut.coalesce(1).write.mode("append").parquet(f"{landing}/part={part}")
    schema = "id long, entity long, at long, value string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{landing}/part=*")
    root = str(tmp_path / "feed")
    query = change_feed.start_change_feed(stream, root, f"{root}/cp", "entity", ["at", "id"], ["id", "value"], bucket_rows=2, min_rows=10, parts=20)
    query.awaitTermination()
    got = {(r.id, r.previous.id if r.previous else None) for r in change_feed.read_transitions(spark, root).collect()}
    batch = G.consecutive_versions(spark.createDataFrame(rows, schema), "entity", ["at", "id"], ["id", "value"])
    assert got == {(r.id, r.previous.id if r.previous else None) for r in batch.collect()}


def test_snapshot_stream(spark, tmp_path, fixtures):
    root = str(tmp_path / "registry")
    stream = snapshots.stream_snapshot_files(spark, f"{fixtures}/snapshots")
    change_feed.start_snapshot_feed(stream, root, f"{root}/cp").awaitTermination()
    listed = snapshots.list_snapshots(spark, root).orderBy("snapshot_id").collect()
    assert [(r.snapshot_id[-21:], r.entry_count) for r in listed] == [("20260601T000000000000Z"[-21:], 8), ("20260602T000000000000Z"[-21:], 8)]
    assert event_store.read_events(spark, root).count() == 13
    assert monitor.scan_history(spark, root).count() == 2
