"""Changes between node tables are those of the documents, whatever their depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import entity_diff as C
from driftmark.operators import node_diff as N

NAMES = ["a", "b", "a.b", 'q"\\', "ü", "tab\t", "raw_public_fhir", "structured_text_sections"]


def value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.5:
        return {k: value(rng, depth - 1) for k in rng.sample(NAMES, rng.randint(0, 4))}
    if kind < 0.6:
        return [value(rng, 0) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 0, 1.5, "x", "", "line\nend", {}])


def edited(rng, v):
    if isinstance(v, dict):
        kept = {k: edited(rng, m) for k, m in v.items() if rng.random() > 0.15}
        if rng.random() < 0.2:
            kept[rng.choice(NAMES)] = value(rng, 2)
        return kept
    return v if rng.random() > 0.15 else value(rng, 2)


def frame(spark, docs):
    rows = [(k, None if d is None else json.dumps(d), "other") for k, d in docs.items()]
    return spark.createDataFrame(rows, "k int, d string, path string").select("k", F.parse_json("d").alias("doc"), "path")


def by_documents(before, after):
    pairs = before.select("k", F.col("doc").alias("before")).join(after.select("k", F.col("doc").alias("after")), "k")
    changes = C.document_changes(pairs)
    shown = [F.when(F.col(s).isNotNull(), V.canonical(F.col(s))).alias(s) for s in ("before", "after")]
    return rows(changes.select("k", "path", "field", *shown))


def rows(df):
    return sorted((r.k, tuple(r.path), r.field, r.before or "", r.after or "") for r in df.collect())


def by_nodes(before, after, levels=N.LEVELS):
    nodes = [N.node_table(df, ["k"], levels=levels) for df in (before, after)]
    return N.NodeDiff(*nodes, ["k"])


def test_node_changes_are_the_changes_of_documents(spark):
    rng = random.Random(7)
    old = {i: {k: value(rng, 4) for k in NAMES} for i in range(150)}
    new = {i: edited(rng, d) for i, d in old.items() if i % 10}
    new |= {1000: {"a": {"b": 1}}, 3: [1], 4: {"a": {"deep": {}}}}
    old |= {4: {"a": 1}, 5: [1], 6: "text"}
    new |= {5: [1], 6: {"a": {"b": {}}, "c": 2}}
    before, after = frame(spark, old), frame(spark, new)
    expected = by_documents(before, after)
    assert len(expected) > 300 and any(b and not a for *_, b, a in expected)
    assert rows(by_nodes(before, after).texts()) == expected
    assert rows(by_nodes(before, after, levels=1).texts()) == expected


def test_node_tables_carry_no_documents(spark):
    docs = {1: {"a": {"b": [1, {"c": 2}]}, "e": {}, "n": None}, 2: None}
    nodes = N.node_table(frame(spark, docs), ["k"])
    assert nodes.columns == ["k", "path", "is_object", "h64", "h32", "value"]
    got = {(r.k, ".".join(r.path)): (r.is_object, r.value) for r in nodes.collect()}
    assert got == {
        (1, ""): (True, None), (1, "a"): (True, None), (1, "a.b"): (False, '[1,{"c":2}]'), (1, "e"): (True, "{}"),
        (1, "n"): (False, "null"), (2, ""): (False, "null"),
    }


@pytest.mark.parametrize("depth", [9, 60])
def test_deep_documents_go_through_rounds(spark, depth):
    def chain(end):
        doc = end
        for _ in range(depth):
            doc = {"a": doc}
        return doc

    before, after = frame(spark, {1: chain({"x": 1, "y": 2}), 2: chain({"x": 1})}), frame(spark, {1: chain({"x": 1, "y": 3}), 2: {"b": chain(1)}})
    diff = by_nodes(before, after)
    path = ".".join("a" * depth)
    got = {(r.k, r.field): (r.before, r.after) for r in diff.texts().collect()}
    assert got == {
        (1, path + ".y"): ("2", "3"),
        (2, "a"): (json.dumps(chain({"x": 1})["a"], separators=(",", ":")), None),
        (2, "b"): (None, json.dumps(chain(1), separators=(",", ":"))),
    }
    assert {(r.k, r.field, r.absent) for r in diff.changes().collect()} == {(1, path + ".y", None), (2, "a", "after"), (2, "b", "before")}


def test_leaves_of_a_change_stay_rows(spark):
    before, after = frame(spark, {1: {}}), frame(spark, {1: {"big": {f"m{i}": {"v": i} for i in range(200)}}})
    diff = by_nodes(before, after)
    assert [(r.field, r.absent) for r in diff.changes().collect()] == [("big", "before")]
    leaves = diff.leaves().collect()
    assert len(leaves) == 200 and {(r.field, r.side) for r in leaves} == {("big", "after")}
    assert {(r.leaf[1], r.value) for r in leaves} == {(f"m{i}", str(i)) for i in range(200)}


def test_empty_and_null_keyed_tables(spark):
    none, some = frame(spark, {}), frame(spark, {1: {"a": 1}})
    nulls = some.withColumn("k", F.lit(None).cast("int"))
    for before, after in ((none, none), (none, some), (some, none), (nulls, nulls)):
        assert by_nodes(before, after).texts().count() == 0
