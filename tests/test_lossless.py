"""Cases in which data was once lost or misjudged."""

import pytest
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import entity_diff as C
from driftmark.operators import events as E
from driftmark.operators import feed as B
from driftmark.operators import identity as I
from driftmark.operators import prices as P
from driftmark.sources import bundles, event_store


def documents(spark, rows):
    columns = ["before", "after"]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "entity_id string, before string, after string")
    return df.select("entity_id", *[F.parse_json(c).alias(c) for c in columns])


def test_a_value_that_moves_to_another_column_is_a_change(spark):
    schema = "k int, a string, b string"
    before = spark.createDataFrame([(1, None, "x"), (2, "y", None), (3, "z", None)], schema)
    after = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "z", None)], schema)
    kinds = {r.k: r.kind for r in C.classify_entities(before, after, "k").collect()}
    assert kinds == {1: "changed", 2: "changed", 3: "unchanged"}


def test_identity_goes_by_the_kind_of_value(spark):
    rows = ['{"id":"0","name":"n"}', '{"id":"false","name":"n"}', '{"id":0,"name":"n"}', '{"id":false,"name":"n"}', '{"id":[],"name":"n"}', '{"id":{},"name":"n"}', '{"id":"","name":"n"}', '{"id":7}', '{"id":true}', '{"id":[1]}', '{"id":null,"name":"[]"}']
    df = spark.createDataFrame([(r,) for r in rows], "d string").select(I.identity_of(F.parse_json("d"), F.lit("none")).alias("i"))
    assert [r.i for r in df.collect()] == ["0", "false", "n", "n", "n", "n", "n", "7", "true", "[1]", "[]"]


def test_one_number_in_two_spellings_is_no_change(spark):
    pairs = documents(spark, [('{"a":1e2,"t":"x:1.0,"}', '{"a":100,"t":"x:1.0,"}'), ('[1.0,2]', '[1,2.0]'), ('{"a":"1.0"}', '{"a":"1"}'), ('{"a":1.5}', '{"a":1}')])
    changed = [r.entity_id for r in C.document_changes(pairs).select("entity_id").distinct().orderBy("entity_id").collect()]
    assert changed == ["2", "3"]


def nested(depth, leaf):
    return '{"a":' * depth + leaf + "}" * depth


def test_depth_is_measured(spark):
    pairs = documents(spark, [(nested(30, "1"), nested(30, "2")), ('{"s":"[[[[{{{{\\\\"}', "{}")])
    assert V.measured_depth(pairs, "before", "after") == 30
    assert {r.field for r in C.document_changes(pairs).collect()} == {".".join("a" * 30), "s"}
    leaves = spark.createDataFrame([(nested(20, '["x",["y"]]'),)], "d string").select(F.parse_json("d").alias("d"))
    assert sorted(r.text for r in V.text_leaves(leaves, "d").collect()) == ["x", "y"]


def test_a_change_of_currency_is_one_of_amount(spark):
    pairs = documents(spark, [('[{"value":12,"currency":"EUR"}]', '[{"value":12,"currency":"USD"}]'), ('[{"value":12,"currency":"EUR"}]', '[{"value":15,"currency":"EUR"}]')])
    got = {r.entity_id: (r.verdict, r.visible) for r in P.price_document_verdicts(pairs, ["entity_id"]).collect()}
    assert got == {"0": ("amount", True), "1": ("amount", True)}


def test_a_stored_price_event_is_in_the_feed(spark, tmp_path):
    pairs = documents(spark, [('{"id":"p","pricing_information":[{"value":12,"currency":"EUR"}]}', '{"id":"p","pricing_information":[{"value":15,"currency":"EUR"}]}')])
    at = "2026-07-01T08:00:00+00:00"
    event_store.append_events(E.build_change_events(pairs, at, at, at), str(tmp_path), "b1")
    rows = B.feed_events(E.in_sequence(event_store.read_events(spark, str(tmp_path)))).collect()
    assert [(r.entity_key, r.field, r.price_visible) for r in rows] == [("p", "pricing_information", True)]
    none = documents(spark, []).filter("false")
    assert event_store.append_events(E.build_change_events(none, at, at, at), str(tmp_path), "b1") == 0
    assert event_store.read_batches(spark, str(tmp_path)).count() == 0


def test_an_unreadable_page_stops_the_read_by_name(spark, tmp_path):
    (tmp_path / "page_1.json").write_text('{"entry":[{"resource":{"id":"a"}}]}')
    (tmp_path / "page_2.json").write_text('{"entry":[{"resource":{"id":"b"')
    with pytest.raises(Exception, match="page_2.json"):
        bundles.read_bundles(spark, str(tmp_path)).collect()
