"""Nested diff, identity, snapshots and change events on JSON documents."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import entity_diff as C
from driftmark.operators import events as E
from driftmark.operators import feed as B
from driftmark.operators import prices as P
from driftmark.sources import event_store, snapshots


def documents(spark, pairs):
    df = spark.createDataFrame([(i, json.dumps(b), json.dumps(a)) for i, (b, a) in enumerate(pairs)], "i int, b string, a string")
    return df.select("i", F.parse_json("b").alias("before"), F.parse_json("a").alias("after"))


def diff(spark, before, after, **options):
    rows = C.document_changes(documents(spark, [(before, after)]), **options)
    got = rows.select("field", V.canonical(F.col("before")), V.canonical(F.col("after"))).collect()
    return sorted((f, json.loads(b), json.loads(a)) for f, b, a in got)


def test_subtree_on_one_side_is_one_change(spark):
    assert diff(spark, {"a": {"x": 1}}, {"b": {"y": {"z": 1}}, "a": {"x": 1}}) == [("b", None, {"y": {"z": 1}})]


def test_null_key_on_one_side_is_a_change(spark):
    assert diff(spark, {}, {"n": None}) == [("n", None, None)]


NUMBERS = st.one_of(
    st.integers(-(10**17), 10**17), st.floats(allow_nan=False, allow_infinity=False, width=32), st.floats(-1e18, 1e18, allow_nan=False), st.sampled_from([1e7, 1e-4, 1e20, -0.0, 1.5, 100.0, 5e-324, 1.7e308])
)


def test_numbers_are_compared_by_value(spark):
    written = ["1e7", "10000000", "1.0E+7", "1e-4", "0.0001", "0.00010", "1e20", "100000000000000000000", "-0.0", "0", "-12.50", "-125e-1", '"1e7 and 1.0"', '["1.0",1.0,{"1.50":2.50}]']
    df = spark.createDataFrame(list(enumerate(written)), "i int, t string").orderBy("i").select(V.canonical(F.parse_json("t")))
    assert [r[0] for r in df.collect()] == ["10000000"] * 3 + ["0.0001"] * 3 + ["1" + "0" * 20] * 2 + ["0"] * 2 + ["-12.5"] * 2 + ['"1e7 and 1.0"', '["1.0",1,{"1.50":2.5}]']
    assert diff(spark, {"a": 1e7, "b": 0.0001, "c": 1e20, "d": [1.0, 2e3]}, {"a": 10000000, "b": 1e-4, "c": 10**20, "d": [1, 2000]}) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(NUMBERS, min_size=1, max_size=60))
def test_plain_numbers_keep_their_value(spark, numbers):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(numbers)], "i int, t string").orderBy("i")
    for x, row in zip(numbers, df.select(V.canonical(F.parse_json("t")).alias("c")).collect()):
        assert "e" not in row.c.lower() and (row.c == str(x) if isinstance(x, int) else float(row.c) == x) and not (("." in row.c) and row.c.endswith("0"))


def test_type_change_lists_and_numbers(spark):
    before = {"t": {"a": 1}, "l": [1, 2], "n": 1, "same": [{"k": 1}]}
    after = {"t": "text", "l": [2, 1], "n": 1.0, "same": [{"k": 1.0}]}
    assert diff(spark, before, after) == [("l", [1, 2], [2, 1]), ("t", {"a": 1}, "text")]


def test_ignored_and_dotted_paths(spark):
    before = {"raw_public_fhir": {"m": 1}, "structured_text_sections": [1], "x": {"a.b: c": 1}, "raw_public_fhirs": 1}
    after = {"raw_public_fhir": {"m": 2}, "content_sections": [], "x": {"a.b: c": 2}, "raw_public_fhirs": 2}
    assert diff(spark, before, after) == [("raw_public_fhirs", 1, 2), ("x.a.b: c", 1, 2)]


def test_root_change_and_depth_guard(spark):
    assert diff(spark, [1], [2]) == [("<root>", [1], [2])]
    deep_b, deep_a = {"a": {"b": {"c": 1}}}, {"a": {"b": {"c": 2}}}
    assert diff(spark, deep_b, deep_a, max_depth=3) == [("a.b.c", 1, 2)]
    with pytest.raises(Exception, match="max_depth"):
        diff(spark, deep_b, deep_a, max_depth=2)


def plain_diff(before, after, path=()):
    if before == after:
        return []
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for k in sorted(before.keys() | after.keys()):
            if k in before and k in after:
                out += plain_diff(before[k], after[k], (*path, k))
            else:
                out.append((".".join((*path, k)), before.get(k), after.get(k)))
        return out
    return [(".".join(path) or "<root>", before, after)]


json_values = st.recursive(
    st.none() | st.integers(2, 9) | st.text("xy", max_size=2), lambda c: st.lists(c, max_size=2) | st.dictionaries(st.sampled_from("abc"), c, max_size=3), max_leaves=8
)
json_objects = st.dictionaries(st.sampled_from("abc"), json_values, max_size=3)


def test_random_documents(spark):
    pairs = []

    @settings(max_examples=150, database=None, deadline=None)
    @given(json_objects, json_objects)
    def draw(b, a):
        pairs.append((b, a))

    draw()
    rows = C.document_changes(documents(spark, pairs)).select("i", "field", V.canonical(F.col("before")).alias("b"), V.canonical(F.col("after")).alias("a")).collect()
    got = sorted((r.i, r.field, json.dumps(json.loads(r.b), sort_keys=True), json.dumps(json.loads(r.a), sort_keys=True)) for r in rows)
    want = sorted(
        (i, f, json.dumps(x, sort_keys=True), json.dumps(y, sort_keys=True)) for i, (b, a) in enumerate(pairs) for f, x, y in plain_diff(b, a)
    )
    assert got == want


def test_display_and_json_text(spark):
    values = [["b", "a"], {"k": [2, 1], "n": None, "t": True}, "  x  y ", None, 5, {"a-b": 1, "a": 2}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    rows = df.select("i", V.display_value(F.col("v")).alias("d"), V.json_text(F.col("v")).alias("j")).orderBy("i").collect()
    assert [r.d for r in rows] == ["a\nb", "k:1\n2\nt:True", "x y", "None", "5", "a:2\na-b:1"]
    assert [r.j for r in rows] == [json.dumps(v, sort_keys=True) for v in values]


def test_walk_and_leaves(spark):
    doc = {"b": [{"x": "q"}, "r"], "a": "p", "n": 1}
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("v"))
    leaves = V.text_leaves(df, "v").orderBy("node_pos").collect()
    assert [(".".join(r.path), r.text) for r in leaves] == [("a", "p"), ("b.0.x", "q"), ("b.1", "r")]
    assert V.walk(df, "v").count() == 7
    with pytest.raises(Exception, match="max_depth"):
        V.walk(df, "v", max_depth=2).collect()


# ---- snapshots and events --------------------------------------------------------------------------


def test_reading_snapshot_files(spark, fixtures):
    rows = snapshots.index_entries(snapshots.read_snapshot_files(spark, f"{fixtures}/snapshots"))
    first = rows.filter("snapshot_id like '%20260601%'")
    assert sorted(r.entity_id for r in first.collect()) == ["00001", "00002", "00003", "00004", "00005", "Nur Name", "ident", "position-8"]
    two = first.filter("entity_id = '00002'").select(V.at(F.col("doc"), "name")).first()[0]
    assert two == "Zwei"
    assert snapshots.read_snapshot_files(spark, f"{fixtures}/empty_snapshots").count() == 0
    with pytest.raises(Exception, match="invalid entries"):
        snapshots.read_snapshot_files(spark, f"{fixtures}/bad_snapshots").collect()


@pytest.fixture(scope="module")
def events(spark, fixtures):
    rows = snapshots.index_entries(snapshots.read_snapshot_files(spark, f"{fixtures}/snapshots"))
    old = rows.filter("snapshot_id like '%20260601%'").select("entity_id", F.col("doc").alias("before"))
    new = rows.filter("snapshot_id like '%20260602%'").select("entity_id", F.col("doc").alias("after"))
    pairs = old.join(new, "entity_id", "full_outer")
    return E.build_change_events(pairs, "2026-06-01T00:00:00+00:00", "2026-06-02T00:00:00+00:00", "2026-06-02T01:00:00+00:00").persist()


def test_events_of_two_snapshots(events):
    got = {(r.entity_id, r.field, r.change_type) for r in events.select("entity_id", "field", "change_type").collect()}
    assert got == {
        ("00005", "<entry>", "removed_diga"),
        ("00006", "<entry>", "new_diga"),
        ("unknown", "<entry>", "new_diga"),
        ("unknown", "<entry>", "removed_diga"),
        ("00002", "name", "text_change"),
        ("00002", "status", "status_change"),
        ("00002", "descriptive_texts.questionnaire.Nachweis der Studie", "text_change"),
        ("00002", "descriptive_texts.health_app.x_y", "text_change"),
        ("00003", "descriptive_texts.health_app.d", "text_change"),
        ("00003", "pricing_information", "price_change"),
        ("00004", "source_update_notice.last_updated_at", "text_change"),
        ("00004", "neu", "other_field_change"),
        ("Nur Name", "status", "status_change"),
    }


def one(events, entity, field):
    return events.filter((F.col("entity_id") == entity) & (F.col("field") == field)).first()


def test_event_context_and_summary(events):
    inferred = one(events, "00002", "descriptive_texts.questionnaire.Nachweis der Studie")
    assert inferred.main_section == "Informationen zum positiven Versorgungseffekt"
    assert inferred.field_label == "Informationen zum positiven Versorgungseffekt > Nachweis der Studie"
    assert inferred.localization_confidence == "medium" and inferred.stable_key is None
    assert [t.op for t in inferred.word_diff] == ["equal", "equal", "insert", "equal"]
    assert inferred.text_change_kind == "text_added"
    assert inferred.summary == f"Im Abschnitt '{inferred.field_label}' wurde Text ergänzt."
    both = one(events, "00002", "descriptive_texts.health_app.x_y")
    assert both.stable_key == "k|descriptive_texts.health_app.x_y" and both.display_path == "Beschreibung der DiGA > x y"
    stored = one(events, "00002", "name")
    assert stored.field_label == "Abschnitt > Frage" and stored.localization_confidence == "high"
    status = one(events, "00002", "status")
    assert status.field_label == "Aufnahmestatus" and status.word_diff is None
    assert status.summary == "Der Aufnahmestatus wurde von 'provisional' auf 'listed' geändert."
    price = one(events, "00003", "pricing_information")
    assert '"currency": "EUR", "value": 10}' in price.summary and price.summary.startswith("Die Preisangabe wurde von [{")
    gone = one(events, "00005", "<entry>")
    assert json.loads(str(gone.before))["manufacturer"] == "M5" and gone.after is None
    assert gone.manufacturer == "M5" and gone.entity_name == "Weg"


def test_legacy_names(events):
    row = E.legacy_events(events).filter("diga_id = '00002' and changed_field = 'status'").first()
    assert row.field_name == "status" and str(row.before_value) == '"provisional"' and row.user_facing_field_label == "Aufnahmestatus"


def test_event_files_and_feed(spark, fixtures):
    raw = event_store.read_event_files(spark, f"{fixtures}/events")
    assert raw.count() == 11
    seq = raw.withColumn("seq", F.xxhash64("_source_file") % 1000 * 1000 + F.col("_place"))
    assert raw.filter("field = 'evidence_summary_text'").select(V.as_text(F.col("before"))).first()[0] == "12 Monate"
    # A present null wins over the earlier name of the value.
    assert raw.filter("field = 'status'").select(V.is_blank(F.col("before"))).first()[0]
    real = seq.filter(B.is_real(seq))
    assert sorted(r.field for r in real.collect()) == ["descriptive_texts.questionnaire.Angabe", "evidence_summary_text", "indication", "name", "status"]
    assert seq.filter(B.is_notifiable(seq)).count() == 7
    assert seq.filter(B.is_notifiable(seq, include_simulated=True)).count() == 8
    shown = B.feed_events(real)
    assert sorted((r.field, r.score) for r in shown.collect()) == [("descriptive_texts.questionnaire.Angabe", 50), ("name", 0), ("status", 0)]
    groups = B.feed_groups(seq.filter(B.is_notifiable(seq))).orderBy("local_date").collect()
    assert [(str(g.local_date), g.adjustments, g.source_update_notice) for g in groups] == [("None", 1, None), ("2026-06-02", 2, "02.06.2026 09:43")]
    assert B.in_local_dates(seq, "2026-06-02", "2026-06-02").count() == 10
    title = raw.filter("field = 'status'").select(E.event_title(F.col("change_type"), V.as_text(F.col("after")))).first()[0]
    assert title == "Streichung"


def test_price_document_verdicts(spark):
    line = lambda amount, start, end=None: {"period": {"start": start, "end": end}, "c": [{"value": amount, "currency": "EUR"}]}
    pairs = [
        ([line(1, "2026-01-01"), line(2, "2026-02-01")], [line(2.0, "2026-02-01"), line(1, "2026-01-01")]),
        ([line(1, "2026-01-01")], [line(2, "2026-01-01")]),
        ([line(1, "2026-01-01")], [line(1, "2026-01-01"), line(1, "2026-03-01")]),
        ("589,00 €", "649,00 €"),
        ({"text": "jetzt 12,50 €"}, {"text": "jetzt 12.50 EUR"}),
        ([line(1, "2026-01-01T10:00:00Z")], [line(1, "2026-01-01")]),
        ([], [line(5, "2026-01-01")]),
    ]
    rows = P.price_document_verdicts(documents(spark, pairs), ["i"]).orderBy("i").collect()
    assert [(r.verdict, r.visible, r.semantic) for r in rows] == [
        ("order", False, False), ("amount", True, True), ("period", True, True), ("opaque", False, True),
        ("order", False, False), ("order", False, False), ("amount", True, True),
    ]
    lines = P.price_lines(documents(spark, pairs[2:3]), "after", ["i"]).withColumn("number", F.col("position") + 1)
    texts = [r[0] for r in lines.orderBy("position").select(P.price_text(lines)).collect()]
    assert texts == ["Preiszeitraum 1: 1 EUR, gültig ab 01.01.2026", "Preiszeitraum 2: 1 EUR, gültig ab 01.03.2026"]


def test_multi_key_match_and_targets(spark):
    events = spark.createDataFrame(
        [(1, "7", "X", None), (2, None, "beta", "https://e/1"), (3, "zzz", "", ""), (4, "A", "b", "c")], "e int, id string, name string, url string"
    )
    entries = spark.createDataFrame(
        [(0, "e0", "1", None, "Beta", "https://E/1"), (1, "e1", "7", "x", "Gamma", ""), (2, "e2", "a", None, "B", None)],
        "pos int, key string, id string, identifier string, name string, url string",
    )
    got = B.match_entities(events, "e", ["id", "name", "url"], entries, "key", ["id", "identifier", "name", "url"], "pos")
    assert {(r.e, r.key) for r in got.collect()} == {(1, "e1"), (2, "e0"), (3, None), (4, "e2")}


def shown(value):
    """The display text in plain Python."""
    if isinstance(value, dict):
        return "\n".join(f"{k}:{shown(v)}" for k, v in sorted(value.items()) if v is not None)
    if isinstance(value, list):
        return "\n".join(sorted(shown(v) for v in value))
    return {True: "True", False: "False", None: "None"}[value] if value is None or isinstance(value, bool) else " ".join(str(value).split())


def test_display_and_json_text_at_any_depth(spark):
    inner = {"b": [3, "x, y: {z}", None, ["d", "c"]], "a": {}, "e": [], "n": None, 'q"\\\t,:[': True, "t": "two  \n words", "f": 1.5}
    docs = [inner, [inner, [2, 1], "s"], {}, [], [[]], "text", 7, None]
    for _ in range(40):
        docs.append({"k": [docs[-1] if len(docs) > 8 else inner, "z", "a"]})
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string").select("i", F.parse_json("d").alias("v"))
    texts = df.select("i", *[V.display_value(F.col("v"), n).alias(f"l{n}") for n in (0, 1, 12)], V.json_text(F.col("v")).alias("j")).orderBy("i").collect()
    for row, doc in zip(texts, docs):
        assert row.l0 == row.l1 == row.l12 == shown(doc), row.i
        assert row.j == json.dumps(doc, sort_keys=True), row.i
    deep = [r.l12 for r in df.select(V.display_value(F.parse_json(F.lit(json.dumps(docs[-1]).replace('"z", "a"', '"a", "z"')))).alias("l12")).limit(1).collect()]
    assert deep == [texts[-1].l12]
