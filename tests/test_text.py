"""Text, time and money columns, and the word diff, against plain Python."""

import difflib
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.functions import money as M
from driftmark.functions import text as X
from driftmark.functions import times as D
from driftmark.operators import events as E
from driftmark.operators import textdiff as W

OPS = {"  ": "equal", "- ": "delete", "+ ": "insert"}


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text_handles_every_white_space(spark):
    values = ["  a  b\t\nc d ", "", " \x1c ", "x\x1fy", "plain"]
    assert column(spark, values, X.clean_text) == [re.sub(r"\s+", " ", v).strip() for v in values]
    assert column(spark, values, X.word_count) == [len(v.split()) for v in values]
    assert column(spark, values, X.words) == [v.split() for v in values]
    assert column(spark, values, X.has_text) == [bool(v.strip()) for v in values]


def test_strip_leading_label(spark):
    values = ["Label: text", "no label", ":x", "a" * 180 + ": y", "a" * 181 + ": y"]
    assert column(spark, values, X.strip_leading_label) == ["text", "no label", "x", "y", "a" * 181 + ": y"]


def test_slugs_and_names(spark):
    assert column(spark, ["Größe & Übung!", "", "x" * 100], X.slugify) == ["groesse-uebung", "diga", "x" * 80]
    assert column(spark, [" a/b c ", "***"], X.safe_name) == ["a_b_c", "diga"]
    key = column(spark, ["A > B"], X.key_part)[0]
    assert re.fullmatch(r"a-b-[0-9a-f]{10}", key)


def test_first_texts(spark):
    df = spark.createDataFrame([("", "  ", " b  c "), (None, "x", "y")], "a string, b string, c string")
    got = [r[0] for r in df.select(X.first_text(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["b c", "x"]
    assert column(spark, [["", " q "], []], X.first_item_text, "array<string>") == ["q", None]
    assert column(spark, [["b", "", "a", "b", None]], X.distinct_truthy, "array<string>") == [["b", "a"]]


def test_compaction(spark):
    assert column(spark, ["abc  def", "a" * 30], lambda c: X.compact(c, 10)) == ["abc def", "a" * 7 + "..."]
    long = " ".join(str(i) for i in range(40))
    assert column(spark, [long, "a  b"], X.first_words) == [" ".join(str(i) for i in range(36)) + " ...", "a  b"]


def test_display_paths(spark):
    values = ["A >  > Steckbrief zu Ihrer DiGA: > x ", "single", ""]
    assert column(spark, values, X.display_path) == ["A > Steckbrief der DiGA > x", "single", ""]
    assert column(spark, values, X.path_title) == ["x", "single", ""]
    assert column(spark, values, X.path_parents) == ["A > Steckbrief der DiGA", None, None]


def test_labels(spark):
    labels = {"a.b": "both", "a": "root"}
    assert column(spark, ["a.b", "a.c", "z.q", ""], lambda c: X.label_for(c, labels)) == ["both", "root", "z", "Unbekannter Bereich"]


def test_section_routes(spark):
    values = ["Nachweis der STUDIE", "Datenschutz", "Nutzung der App", "Preis", "Sonstiges", "Studie zum Datenschutz"]
    assert column(spark, values, X.route_section) == [
        "Informationen zum positiven Versorgungseffekt",
        "Informationen zu Datenschutz und Datensicherheit",
        "Weitere Informationen zur digitalen Gesundheitsanwendung",
        "Weitere Informationen",
        "Beschreibung der DiGA",
        "Informationen zum positiven Versorgungseffekt",
    ]


def test_times(spark):
    values = ["2026-06-02T09:43:08.192+02:00", "2026-06-02T07:43:08Z", "2026-06-02", "2026-01-02T03:04:05", "junk", "", None]
    parsed = [str(v) if v else None for v in column(spark, values, lambda c: D.parse_time(c).cast("string"))]
    assert parsed == ["2026-06-02 07:43:08.192", "2026-06-02 07:43:08", "2026-06-02 00:00:00", "2026-01-02 03:04:05", None, None, None]
    assert column(spark, values, D.format_time_text) == ["02.06.2026 09:43", "02.06.2026 09:43", "02.06.2026 02:00", "02.01.2026 04:04", "junk", "", ""]
    assert column(spark, values, D.date_sort_key) == ["2026-06-02", "2026-06-02", "2026-06-02", "2026-01-02", "junk", "", ""]
    assert column(spark, ["2026-06-02", "2026-13-45", "x", ""], D.format_date) == ["02.06.2026", "2026-13-45", "x", None]
    assert column(spark, ["2026-06-02T09:43:08.192+02:00", "bald", None], D.update_notice) == [
        "Zuletzt aktualisiert am 02.06.2026 um 09:43", "Zuletzt aktualisiert am bald", None,
    ]
    names = ["snapshot_20260602T130102618820Z.json", "snapshot_x.json"]
    assert column(spark, names, lambda c: D.snapshot_time(c).cast("string")) == ["2026-06-02 13:01:02.61882", None]
    assert column(spark, ["2026-06-02T13:01:02.707810+00:00"], D.compact_timestamp) == ["20260602T1301027078100000"]


def test_validity(spark):
    df = spark.createDataFrame([("1", "2"), ("1", None), (None, "2"), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(D.validity(F.col("a"), F.col("b"))).collect()] == [
        "gültig von 1 bis 2", "gültig ab 1", "gültig bis 2", "Gültigkeitszeitraum nicht angegeben",
    ]


def test_money(spark):
    values = ["589,00 €", "ab 12.5 eur und 12,5 EUR, 7€", "kostenlos", ""]
    assert column(spark, values, M.amounts_in_text) == [["589.00 €"], ["12.5 EUR", "7 €"], [], []]
    split = [tuple(r) for r in column(spark, ["12,5 €", "649 chf", "frei", "1.0", None, ""], M.split_amount)]
    assert split == [("12.500000", "EUR"), ("649.000000", "CHF"), ("frei", None), ("1.000000", None), (None, None), (None, None)]


def reference_tokens(before, after):
    return [(OPS[x[:2]], x[2:]) for x in difflib.ndiff(before.split(), after.split()) if x[:2] in OPS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab.,", min_size=1, max_size=5), max_size=14), st.lists(st.text("ab.,", min_size=1, max_size=5), max_size=14))
def test_word_tokens_equal_ndiff(before, after):
    b, a = " ".join(before), " ".join(after)
    assert W.word_tokens(b, a) == reference_tokens(b, a)


def test_word_tokens_equal_ndiff_on_long_texts():
    rnd = random.Random(2)
    for _ in range(15):
        pool = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 6))) for _ in range(40)]
        b, a = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(200, 260))) for _ in range(2)]
        assert W.word_tokens(b, a) == reference_tokens(b, a)


def test_word_tokens_of_a_complete_rewrite_do_not_recurse():
    before = " ".join(f"alpha{i}" for i in range(1200))
    after = " ".join(f"alpha{i}x" for i in range(1200))
    ops = [op for op, _ in W.word_tokens(before, after)]
    assert ops.count("delete") == ops.count("insert") == 1200


GOLDEN = [
    ("12 Monate", "17 Monate (12 Monate initial, 5 Monate Verlängerung)", "- + = + + + + + +", "mixed_text_change"),
    ("2026-07-08", "2026-12-08", "- +", "text_modified"),
    ("2026-04-10T14:24:03.755+02:00", "2026-06-02T09:43:08.192+02:00", "- +", "text_modified"),
    (
        "Zuletzt aktualisiert am 10.04.2026 um 12:24", "Zuletzt aktualisiert am 02.06.2026 um 07:43", "= = = - + = - +", "mixed_text_change",
    ),
    ("a b c", "a c", "= - =", "text_removed"),
    ("a c", "a b c", "= + =", "text_added"),
    ("Alles bleibt", "Alles bleibt", "= =", "text_modified"),
    ("x Preis. y", "x Preis, gültig y", "= - + + =", "text_added"),
    ("Eins zwei drei vier.", "Ganz anders sagt er!", "- - - - + + + +", "text_replaced"),
]


def test_golden_diffs_and_kinds(spark):
    df = spark.createDataFrame([(i, b, a) for i, (b, a, _, _) in enumerate(GOLDEN)], "i int, b string, a string")
    rows = df.withColumn("t", W.word_diff("b", "a")).withColumn("kind", W.text_change_kind(F.col("t"))).orderBy("i").collect()
    sign = {"equal": "=", "delete": "-", "insert": "+"}
    assert [(" ".join(sign[t.op] for t in r.t), r.kind) for r in rows] == [(ops, kind) for _, _, ops, kind in GOLDEN]


def test_excerpt_windows(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        size = rnd.randint(0, 120)
        rows.append((i, [(rnd.choices(["equal", "insert", "delete"], [30, 1, 1])[0], f"w{j}") for j in range(size)]))
    df = spark.createDataFrame(rows, "i int, t array<struct<op:string,text:string>>")
    t = F.col("t")
    got = df.withColumn("w", W.excerpt_windows(t, 5, 40)).select(
        "i", "w", W.excerpt_side(t, F.col("w"), "before").alias("b"), W.excerpt_truncated(t, F.col("w")).alias("cut")
    ).orderBy("i").collect()
    for (_, tokens), row in zip(rows, got):
        windows = [tuple(w) for w in row.w]
        changed = [i for i, (op, _) in enumerate(tokens) if op != "equal"]
        # Windows come in order, lie apart, stay within the tokens, and begin and end near a change.
        assert all(0 <= lo < hi <= len(tokens) for lo, hi in windows)
        assert all(b[0] > a[1] for a, b in zip(windows, windows[1:]))
        assert all(any(lo <= c < hi for c in changed) for lo, hi in windows)
        assert all(any(c - 5 <= i <= c + 5 for c in changed) for lo, hi in windows for i in range(lo, hi))
        # Only the first may be over the budget; what is shown covers every change up to the first one left out.
        assert len(windows) < 2 or sum(hi - lo for lo, hi in windows) <= 40
        end = windows[-1][1] if windows else 0
        assert bool(windows) == bool(changed)
        assert all(any(lo <= c < hi for lo, hi in windows) for c in changed if c < end)
        later = [c for c in changed if c >= end]
        if later:
            run = [c for c in changed if c >= later[0]]
            stop = next((a for a, b in zip(run, run[1:]) if b - a > 11), run[-1])
            size = min(len(tokens), stop + 6) - max(0, later[0] - 5)
            assert sum(hi - lo for lo, hi in windows) + size > 40
        shown = [x.text for x in row.b if x.text != "..."]
        if windows:
            assert shown == [x for lo, hi in windows for op, x in tokens[lo:hi] if op != "insert"]
            assert row.cut == (windows[0][0] > 0 or end < len(tokens) or len(windows) > 1)
        else:
            assert len(row.b) == len(tokens) and not row.cut


def test_phrases_and_excerpts(spark):
    df = spark.createDataFrame([("a b c d e", "a X c Y e")], "b string, a string")
    row = df.withColumn("t", W.word_diff("b", "a")).withColumn("r", W.word_runs("b", "a")).select(
        W.first_changed_phrase(F.col("t"), "delete").alias("first"), W.phrase_signature(F.col("t")).alias("sig"),
        W.changed_text(F.col("t"), "insert").alias("added"), W.diff_excerpt(F.col("r")).alias("excerpt"),
        W.changed_words(F.col("t"), "delete").alias("n"), W.long_text_summary(F.col("t"), F.lit("x")).alias("s"), W.removed_runs(F.col("r")).alias("runs"),
    ).first()
    assert row.first == "b" and row.added == "X Y" and row.n == 2 and row.runs == ["b", "d"]
    assert sorted(row.sig.split()) == ["b", "d", "x", "y"]
    assert row.excerpt == "Entfernt: b | Hinzugefügt: X | Entfernt: d | Hinzugefügt: Y"
    assert row.s == "Text stark angepasst · ca. 2 Wörter entfernt, ca. 2 Wörter ergänzt"


def test_line_diff(spark):
    long = "x " * 70
    df = spark.createDataFrame([("a\nb", "a\nc"), (long + "old", long + "new")], "b string, a string")
    rows = df.withColumn("t", W.word_diff("b", "a")).withColumn("l", W.unified_lines("b", "a")).select(
        W.line_diff(F.col("b"), F.col("a"), F.col("l"), F.col("t")).alias("d")
    ).collect()
    assert rows[0].d == ["--- before", "+++ after", "@@ -1,2 +1,2 @@", " a", "-b", "+c"]
    assert rows[1].d[-4:] == ["", "Word-level text changes:", "- old", "+ new"]


def test_boilerplate_and_moved_text(spark):
    assert column(spark, [" Bitte geben Sie hier einen Steckbrief an", "x Steckbrief zu Ihrer DiGA y", "Text", None], E.is_boilerplate) == [True, True, False, False]
    run = " ".join(f"Wort{i}" for i in range(25))
    df = spark.createDataFrame(
        [([f"Frage: {run}"], run.lower()), ([run], "anderes"), ([" ".join(run.split()[:19])], run.lower()), ([run], "")], "r array<string>, blob string"
    )
    assert [r[0] for r in df.select(E.moved_text(F.col("r"), F.col("blob"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("diff", [W.word_diff, W.word_runs, W.unified_lines])
def test_diffs_of_one_batch_are_handed_on_in_pieces(diff):
    """A batch of long texts must not lie in the Python worker as one list of all its tokens."""
    old = "\n".join(f"w{i} x." for i in range(3000))
    rows = [(old, old.replace(". ", "! ").replace(".\n", "!\n")), (None, old), (old, None), (None, None), ("", "a b")] * 12
    batch = tuple(pa.array(side, pa.string()) for side in zip(*rows))
    pieces = list(diff.func(iter([batch])))
    assert max(len(p.values) - len(p[-1].values if p[-1].is_valid else []) for p in pieces) < W.HELD
    assert len(pieces) > 1 and sum(map(len, pieces)) == len(rows)
    found = [x for p in pieces for x in p.to_pylist()]
    assert [x is None for x in found] == [b is None or a is None for b, a in rows]
    assert found[:5] * 12 == found
    assert found[0] and len(found[4]) > 0
