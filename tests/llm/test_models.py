import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmark.llm import decontaminate, langid, pii, toxicity
from driftmark.llm.chars import code_points

LUHN = "4111111111111111"


def test_base_spans_are_the_patterns():
    rnd = random.Random(1)
    alphabet = "ab1290.@+- ()é_%\n"
    parts = ["a.b@c.de", "1.2.3.4", "999.1.1.1", "+1 (22) 333-4444", LUHN, "4111 1111 1111 1111", "@@", "x@y", "a@b.c@d.e", "+", "1.2.3.4.5.6.7.8"]
    for _ in range(1500):
        text = "".join(rnd.choice([*alphabet, *parts]) for _ in range(rnd.randint(0, 25)))
        digits = lambda s: re.sub("[^0-9]", "", s)
        tests = {
            "email": lambda m: True,
            "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m)),
            "phone": lambda m: 8 <= len(digits(m)) <= 15,
        }
        want = {k: [m.span() for m in p.finditer(text) if tests[k](m[0])] for k, p in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE))}
        assert pii.base_spans(text) == want


def test_gradients_of_the_tagger():
    tagger = pii.Tagger.fresh()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, grads = tagger.step(x, y)
    for name in tagger.p:
        at = tuple(rng.integers(0, s) for s in tagger.p[name].shape) if name != "embed" else (int(x[0, 0]), 1)
        old = tagger.p[name][at]
        values = []
        for e in (1e-5, -1e-5):
            tagger.p[name][at] = old + e
            values.append(tagger.step(x, y)[0])
        tagger.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-5 - grads[name][at]) < 1e-3


def test_viterbi_is_the_best_path():
    from itertools import product

    tagger = pii.Tagger.fresh(2)
    x = np.random.default_rng(1).integers(0, pii.CLASSES, (2, 4))
    tagger.p["moves"] += np.random.default_rng(3).normal(0, 1, tagger.p["moves"].shape).astype(np.float32)
    s, _ = tagger.scores(x)
    tags, _ = tagger.decode(x)
    for w in range(2):
        total = lambda path: sum(s[t, w, k] for t, k in enumerate(path)) + sum(tagger.p["moves"][a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert tuple(tags[w]) == max(product(range(pii.TAGS), repeat=4), key=total)


def sample_texts(n):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    out = []
    for _ in range(n):
        data = [f"{word()}.{rnd.randint(1, 99)}@mail{rnd.randint(0, 9)}.example.com", f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", ".".join(str(rnd.randint(1, 255)) for _ in range(4)), LUHN, f"password={rnd.getrandbits(64):x}", str(rnd.randint(1900, 2100))]
        rnd.shuffle(data)
        out.append(" ".join(x for d in data for x in (word(), word(), d, word())))
    return out


def test_tagger_adds_spellings_and_leaves_others_alone(spark):
    tagger = pii.train(sample_texts(60))
    texts = ["write to joe.smith @ mail3.example.com today", "plain words without any", "token 7602ad27cf5550de1c in 2021, chapter 12", None, ""]
    found = pii.added_spans([t or "" for t in texts], tagger)
    assert any(pii.KINDS[k] == "email" and texts[0][s:e].endswith("example.com") for k, s, e in found[0])
    assert found[1:] == [[], [], [], []]
    rows = [(i, t) for i, t in enumerate([*texts, "mail a.1@b.example.com"])] + [(None, "x@y.zz"), (5, "mail a.1@b.example.com")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.personal_data(df, tagger).collect()
    assert len(got) == len(rows) and sorted(r.spans for r in got if r.doc_id == 5) == ["email:5:22"] * 2
    assert pii.personal_data(df.limit(0), tagger).count() == 0 and pii.personal_data(df, None).count() == len(rows)


def test_every_kind_is_learned_from_texts_of_its_own(spark, monkeypatch):
    """No text holds two kinds; emails are many; cards and addresses stand far from any @ or +."""
    made = {"email": "mail a.{0}@b.example.com now", "ip": "host 10.0.0.{0} is up", "card": "paid with 4111 1111 1111 1111 today {0}", "phone": "call +1 (22) 333-4{0}44 now"}
    rows = [(i, ("filler " * 60) + made["email"].format(i % 90 + 10)) for i in range(300)]
    rows += [(1000 + 100 * n + i, ("filler " * 60) + made[k].format(i + 10)) for n, k in enumerate(("ip", "card", "phone")) for i in range(40)]
    rows += [(5000, None), (5001, ""), (5002, "1.2.3.999 and 4111 1111 1111 1112"), (None, "no data")]
    monkeypatch.setattr(pii, "train", lambda parts: parts)
    parts = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    counts = {k: sum(bool(pii.base_spans(p)[k]) for p in parts) for k in pii.KINDS}
    assert counts["ip"] == counts["card"] == counts["phone"] == 40 and 50 < counts["email"] <= 100
    assert len(parts) == sum(counts.values())


def test_reconciled_keeps_the_deepest():
    assert pii.reconciled([(0, 5, 10, 1), (0, 4, 12, 9), (3, 20, 30, 2)]) == [(0, 4, 12), (3, 20, 30)]


LANGS = {"xa": "der die und nicht mit sich auf werden eine", "xb": "le les des une dans pour qui avec sont", "xc": "the of and that with from this which have"}


def language_rows():
    rnd = random.Random(2)
    return [(i, " ".join(rnd.choice(LANGS[k].split()) for _ in range(rnd.randint(20, 60))), k) for i, k in enumerate(list(LANGS) * 60)]


def test_language_profiles(spark, empty):
    df = spark.createDataFrame([*language_rows(), (900, None, "xa"), (901, "  12 !", "xa"), (902, "ohne", None), (None, "und die und der nicht", "xa")], "doc_id long, text string, lang string")
    profiles = langid.learn(df.filter(~langid.held_out(df["doc_id"])))
    assert profiles.langs == ["xa", "xb", "xc"]
    got = langid.predicted(df, profiles, "doc_id", "lang").collect()
    assert len(got) == 184 and all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 900)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.predicted(empty, langid.learn(empty), "doc_id").count() == 0
    stay = langid.accepted(df.withColumn("score", df["lang"]), 0.2)
    assert stay.columns == ["doc_id", "text", "lang", "score"]
    assert {900, 901}.isdisjoint(r.doc_id for r in stay.collect()) and stay.count() == 182


def test_ranks_and_distance_by_hand():
    runs = langid.letter_runs("Ab, ab!")
    assert "".join(map(chr, runs)) == " ab ab "
    keys, counts = langid.counted(runs)
    assert counts.sum() == 7 + 6 + 5 and counts.max() == 3
    profiles = langid.Profiles(["p"], np.sort(langid.ranked(runs)), np.argsort(np.argsort(langid.ranked(runs)))[:, None] * 0)
    ranks = np.empty(len(keys), int)
    ranks[np.argsort(np.argsort(langid.ranked(runs)))] = np.arange(len(keys))
    profiles.ranks = ranks[:, None]
    assert langid.predict("ab ab", profiles) == ("p", 1.0)


def items():
    from tests_llm_helpers import passages

    return [(i, t) for i, t in enumerate(passages(30, 8, 25))] + [(50, None), (51, ""), (52, "tiny"), (None, passages(31, 1, 20)[0]), (60, passages(30, 8, 25)[0])]


def edit_distance_within(pattern, text):
    """Fewest edits that turn pattern into some part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_passages(spark, docs, empty, rows):
    from tests_llm_helpers import passages

    bench = items()
    text = dict((i, t) for i, t in bench)
    filler = passages(40, 6, 50)
    made = [
        (1, filler[0] + " " + text[0] + " " + filler[1]),
        (2, filler[1] + " " + text[1].upper().replace(" ", ",  ") + "! " + filler[2]),
        (3, filler[2] + " " + text[2][:40] + "x" + text[2][41:] + " " + filler[3]),
        (4, filler[3]),
        (5, text[3][:60]),
        (6, None),
        (None, text[4]),
        (6, ""),
        (7, text[5] * 3),
    ]
    df = spark.createDataFrame(made, "doc_id long, text string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in decontaminate.passages(df, benchmark).collect()}
    assert set(got) == {(1, 0), (1, 60), (2, 1), (3, 2), (None, 4), (7, 5)}
    start, end, edits = got[(1, 0)]
    assert made[0][1][start:end].strip() == text[0] and edits == 0
    norm = lambda t: "".join(map(chr, decontaminate.plain(t or "")[0]))
    index = decontaminate.Index([(i, t) for i, t in bench if t])
    for doc_id, t in made:
        want = {index.items[s] for s in range(len(index.segments)) if edit_distance_within("".join(map(chr, index.segments[s])), norm(t)) <= index.edits[s]}
        assert want == {i for d, i in got if d == doc_id} or doc_id == 6
    assert decontaminate.passages(docs, benchmark).count() == 0
    assert decontaminate.passages(empty, benchmark).count() == 0 and decontaminate.passages(df, benchmark.limit(0)).count() == 0


def test_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    bench = [(i, t) for i, t in items() if t and len(t) > 50]
    df = spark.createDataFrame([(10 + i, "before this " + t + " after it") for i, (_, t) in enumerate(bench)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.passages(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {(10 + i, item) for i, (item, _) in enumerate(bench)} <= got


def test_band_counts_lose_no_match():
    """Random edits within the budget: every edited segment is found."""
    from tests_llm_helpers import passages

    rnd = random.Random(12)
    index = decontaminate.Index([(0, passages(50, 1, 40)[0])])
    for trial in range(200):
        s = rnd.randrange(len(index.segments))
        letters = list("".join(map(chr, index.segments[s])))
        for _ in range(int(index.edits[s])):
            i = rnd.randrange(len(letters))
            kind = rnd.randrange(3)
            letters[i : i + 1] = [] if kind == 0 else ["q"] if kind == 1 else [letters[i], "q"]
        text = passages(60 + trial, 1, 12)[0] + " " + "".join(letters) + " " + passages(90 + trial, 1, 12)[0]
        assert any(m[0] == s for m in index.matches(code_points(text)))


def test_excerpts_at_every_word_and_with_replaced_words():
    from tests_llm_helpers import passages

    bench = passages(51, 4, 60)
    index = decontaminate.Index(list(enumerate(bench)))
    filler = passages(52, 2, 40)

    def found(part):
        return {index.items[m[0]] for m in index.matches(code_points(f"{filler[0]} {part} {filler[1]}"))}

    for item, text in enumerate(bench):
        words = text.split()
        for size in range(13, 21):
            for start in range(0, len(words) - size + 1, 3):
                assert found(" ".join(words[start : start + size])) == {item}
        spoilt = [("zzzzz" if i % 12 == 5 else w) for i, w in enumerate(words)]
        assert found(" ".join(spoilt)) == {item}
    assert found(" ".join(filler[1].split()[::-1])) == set()


def test_passages_of_a_text_without_spaces():
    rnd = random.Random(13)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300))
    index = decontaminate.Index([(7, text)])
    for start in (0, 1, 17, 39, 41, 119, 220):
        assert {index.items[m[0]] for m in index.matches(code_points("甲乙" + text[start : start + 80] + "丙丁"))} == {7}


def test_segments_are_counted_in_pieces(monkeypatch):
    from tests_llm_helpers import passages

    index = decontaminate.Index(list(enumerate(passages(53, 3, 40))))
    points = code_points(" ".join(t for _ in range(3) for t in passages(53, 3, 40)))
    whole = sorted(index.matches(points))
    monkeypatch.setattr(decontaminate, "AT_ONCE", 50)
    assert sorted(index.matches(points)) == whole


def test_words_join_what_was_pulled_apart():
    assert toxicity.words("You s t u p i d fool, st.upid! m-o-r-o-n Ünïcode42x 7") == ["you", "stupid", "fool", "stupid", "moron", "ünïcodex"]
    assert toxicity.words("a b") == ["a", "b"] and toxicity.words(" 12 .") == []


def test_kernel_is_that_of_common_subsequences():
    def kernel(s, t):
        total = 0.0
        where = lambda w: [(w[i] + w[j] + w[k], k - i + 1) for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, len(w)) if k - i + 1 <= 3 + toxicity.GAP]
        for a, n in where(f"^{s}$"):
            total += sum(toxicity.DECAY ** (n + m) for b, m in where(f"^{t}$") if a == b)
        return total

    words = ["stupid", "stuxpid", "table", "pathetic"]
    numbers, weights = toxicity.subsequences(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            got = sum(weights[p] * weights[q] for p, q in zip(*np.nonzero((numbers[i][:, None] == numbers[j][None, :]) & (numbers[i] > 0)[:, None])))
            assert got == pytest.approx(kernel(s, t))


def test_toxicity_on_held_out_texts(spark, empty):
    rnd = random.Random(3)
    from tests_llm_helpers import passages

    common = list(dict.fromkeys(" ".join(passages(70, 4, 300)).split()))
    bad = ["stupid", "moron", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(common) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(40), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "you s t u p i d one"), (903, "a mo.ron here"), (904, "so worthxless now"), (None, "moron"), (0, rows[0][1]), (905, "m" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (905, None)], "doc_id long, toxic int")
    model = toxicity.learn(toxicity.teachable(docs), toxicity.teachable(marks))
    got = toxicity.scored(docs, model, "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r.predicted for r in got}
    assert all(by_id[i] == t for i, t in labels)
    assert [by_id[i] for i in (900, 901, 902, 903, 904, None, 905)] == [0, 0, 1, 1, 1, 1, 0]
    assert toxicity.scored(empty, toxicity.learn(empty, marks.limit(0)), "doc_id").count() == 0


@pytest.mark.parametrize("share", [0.05, 0.33, 0.5, 0.8])
def test_toxicity_at_any_balance_of_labels(spark, share):
    rnd = random.Random(6)
    from tests_llm_helpers import passages

    common = list(dict.fromkeys(" ".join(passages(71, 4, 300)).split()))
    bad = ["stupid", "moron", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(common) for _ in range(40)]
        toxic = rnd.random() < share
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(40), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(toxicity.teachable(docs), toxicity.teachable(marks))
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, model, "doc_id").collect()}
    found = [got[i] for i, t in labels if t]
    flagged = [got[i] for i, t in labels if not t]
    assert sum(found) >= 0.98 * len(found) and sum(flagged) <= 0.02 * len(flagged)


def test_toxic_labels_that_teach_nothing_are_reported(spark):
    docs = spark.createDataFrame([(i, "all the same words") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no toxic word"):
        model = toxicity.learn(docs, marks)
    assert {r.predicted for r in toxicity.scored(docs, model, "doc_id").collect()} == {0}


def test_signs_of_every_plane_that_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox and the lazy dog " * 20, "en") for i in range(8)], "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert langid.predict("\U0001f600\U0001f600 \U0001f389", profiles)[0] == "und" and langid.predict("𝔘𝔫𝔦 the", profiles)[0] == "en"


def test_long_runs_do_not_overflow_the_pattern_engine(spark):
    rnd = random.Random(8)
    texts = ["1" * 20_000, "a@" + ".bc" * 6000, "+" + "1 " * 9000 + "1", "4" + " 4" * 15_000, "1.1" * 9000]
    texts += [f"write to user{i}@mail{i}.example.org or call +49 30 {rnd.randrange(10**7, 10**8)}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {k: [r[0] for r in docs.orderBy("doc_id").select(pii._base_matches(k, F.col("text"))).collect()] for k in pii.KINDS}
    assert found == {k: [[t[a:b] for a, b in pii.base_spans(t)[k]] for t in texts] for k in pii.KINDS}
    assert pii.learn(docs) is not None


def test_a_row_slice_never_loses_rows(rows):
    from driftmark.llm.tokens import slices

    texts = pa.array([t for _, t in rows], pa.string())
    bounds = list(slices(texts, 2000))
    assert bounds[0][0] == 0 and bounds[-1][1] == len(rows) and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
