import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftmark.llm import exact_dedup, graph, line_dedup, simhash, suffix_dedup


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_exact_groups(docs, empty, rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for doc_id, text in rows:
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for doc_id, text in rows:
        group = groups[norm(text)]
        keep = min(group)[3]
        want.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_names_of_several_contents_are_told_apart(spark):
    """Two rows of equal names and different digests, as two chunks with one 64-bit name would give."""
    schema = "doc_id long, n_chars int, text_sha256 string, names array<long>, digests array<binary>"
    recipe = spark.createDataFrame([(1, 5, "p", [7, 8], [b"a", b"b"]), (2, 5, "q", [7, 8], [b"c", b"b"]), (3, 5, "p", [7, 8], [b"a", b"b"])], schema)
    shared = exact_dedup.shared_names(recipe)
    assert {(r.name, bytes(r.digest)) for r in shared.collect()} == {(7, b"a"), (7, b"c")}
    ids = {r.doc_id: tuple(r.ids) for r in exact_dedup.identifier_lists(recipe, shared).collect()}
    assert ids[1] == ids[3] != ids[2]


def test_chunks_are_the_whole_text(spark, rows):
    df = spark.createDataFrame([(t or "",) for _, t in rows], "t string").select(exact_dedup.normalised(F.col("t")).alias("n"))
    for r in df.select("n", exact_dedup.chunks(F.col("n")).alias("c")).collect():
        assert "".join(r.c) == r.n and all(0 < len(c) <= exact_dedup.MOST for c in r.c)


def near(a, b):
    """Whether one word inserted, left out or replaced turns a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    return max(len(a), len(b)) - n - m <= 1


def test_line_dedup(docs, empty, rows):
    lines = []
    for doc_id, text in {(i, t) for i, t in rows if i is not None and t is not None}:
        for no, line in enumerate(text.split("\n")):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
            if words:
                lines.append(((doc_id, no), words))
    firsts = {}
    for at, words in sorted(lines):
        firsts.setdefault(tuple(words), at)
    gone = defaultdict(dict)
    for at, words in lines:
        if firsts[tuple(words)] < at:
            gone[at] = "equal"
        elif len(words) >= 5 and any(p < at and len(o) >= 5 and near(list(o), words) for o, p in firsts.items()):
            gone[at] = "near"
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["text", "n_equal", "n_near"]
    got = got.collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in got:
        if r.doc_id is None:
            assert (r.n_equal, r.n_near) == (0, 0)
        elif len(by_id[r.doc_id]) == 1:
            text = by_id[r.doc_id][0]
            if text is None:
                assert r.text is None
                continue
            parts = text.split("\n")
            stay = [p for no, p in enumerate(parts) if (r.doc_id, no) not in gone]
            assert r.text == "\n".join(stay)
            assert (r.n_equal, r.n_near) == tuple(sum(gone.get((r.doc_id, no)) == k for no in range(len(parts))) for k in ("equal", "near"))
    assert any(r.n_near for r in got) and line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_edits_of_every_kind_and_place(spark):
    base = [f"w{i}" for i in range(70)]
    texts = [" ".join(base)]
    for i in (0, 1, 31, 32, 35, 69):
        texts += [" ".join(base[:i] + base[i + 1 :]), " ".join([*base[:i], "new", *base[i:]]), " ".join([*base[:i], "new", *base[i + 1 :]])]
    far = [" ".join(["p", "q", *base[2:]]), " ".join(base[:10] + base[12:]), "one two three four", "one two three five"]
    df = spark.createDataFrame(list(enumerate(texts + far)), "doc_id long, text string")
    got = {r.doc_id: r.n_near for r in line_dedup.drop_repeated_lines(df).collect()}
    assert [got[i] for i in range(len(texts))] == [0] + [1] * (len(texts) - 1)
    assert got[len(texts) + 2] == got[len(texts) + 3] == 0


def plain_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_near_groups(docs, empty, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = union(pairs, range(len(rows)))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[roots[i]].append(doc_id)
    want = []
    for i, (doc_id, _) in enumerate(rows):
        known = [d for d in least[roots[i]] if d is not None]
        want.append((doc_id, prints[i] - (1 << 64) if prints[i] >> 63 else prints[i], min(known) if known else None))
    got = [tuple(r) for r in simhash.near_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_groups(empty).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40)
    prints = set(base.tolist())
    for b in base:
        for _ in range(12):
            prints.add(int(b ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 62, rng.integers(1, 4)))))
    low = [int(x) for x in rng.integers(0, 1 << 10, 300)]  # one hot bucket: all but ten bits are equal
    prints = sorted(prints | set(low))
    array = np.array(prints, np.int64).view(np.uint64)
    pairs = [(prints[i], prints[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 3)]
    want = {n: r for n, r in union(pairs, prints).items()}
    linked = {x for p in pairs for x in p}
    got = {r.node: r.root for r in simhash.fingerprint_roots(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {n: want[n] for n in linked}


def test_masks_share_one():
    rng = np.random.default_rng(0)
    for n in (10, 10**9, 10**13):
        many = [m & (1 << 64) - 1 for m in simhash.masks(n)]
        for _ in range(300):
            apart = int(sum({1 << int(b) for b in rng.integers(0, 64, 3)}))
            assert any(apart & m == 0 for m in many)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(40)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(5000, 5000 + i) for i in range(1, 90)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = union([p for p in pairs if p[0] != p[1]], nodes)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group(docs, empty, spark):
    from tests_llm_helpers import passages

    base = passages(9, 6, 300)
    rows = [(i, t, "x") for i, t in enumerate(base)]
    for i, t in enumerate(base[:3]):
        words = t.split()
        words[10], words[200] = "changed", "altered"
        rows += [(100 + i, " ".join(words), "x"), (200 + i, t, "x")]
    rows += [(300, None, "x"), (301, "", "x"), (None, base[0], "x"), (302, "short one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = simhash.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 5, 300, 302, None], key=repr)
    assert simhash.one_of_each_group(empty).count() == 0


def shingle_similarity(x, y, words=5):
    x, y = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def near_copies(spoilt, seed):
    """Texts of 60 to 320 words, and a copy of each in which a word of every so many is replaced, at random."""
    from tests_llm_helpers import passages

    rnd = np.random.default_rng(seed)
    out = []
    for i, text in enumerate(passages(seed, 60, 320)):
        words = text.split()[: 60 + 20 * (i % 14)]
        other = list(words)
        for at in rnd.choice(len(words), max(1, round(len(words) * spoilt)), replace=False):
            other[at] = f"new{at}"
        out.append((" ".join(words), " ".join(other)))
    return out


def test_copies_are_told_by_their_shingles(spark, monkeypatch):
    """Pairs about the similarity of 0.8: those from it on go, those below it stay, in one tile and in many."""
    made = [p for seed, spoilt in enumerate((0.015, 0.02, 0.023, 0.027, 0.03, 0.035), 20) for p in near_copies(spoilt, seed)]
    near = [shingle_similarity(*p) for p in made]
    assert sum(0.8 <= j < 0.85 for j in near) > 50 and sum(0.7 <= j < 0.8 for j in near) > 50
    rows = [(2 * i + k, t) for i, p in enumerate(made) for k, t in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (simhash.COPY_TILE, 90):
        monkeypatch.setattr(simhash, "COPY_TILE", tile)
        stay = {r.doc_id for r in simhash.one_of_each_group(df).collect()}
        assert stay == {i for i, _ in rows} - {2 * i + 1 for i, j in enumerate(near) if j >= 0.8}


def test_rows_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """A group whose members are all about as similar as the bound: no table has a row per pair, and shingles decide every link."""
    from tests_llm_helpers import passages

    rnd, base = np.random.default_rng(31), passages(30, 1, 200)[0].split()
    rows = []
    for i in range(150):
        words = list(base)
        for at in rnd.choice(len(words), 2 if i < 100 else 4, replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    pairs = [(i, j) for i, x in rows for j, y in rows[:i] if shingle_similarity(x, y) >= 0.8]
    want = union(pairs, range(150))
    made = {}
    store = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: made.setdefault(name, store(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile, shingles in ((simhash.COPY_TILE, simhash.SET_SHINGLES), (simhash.COPY_TILE, 5000), (40, 1)):
        monkeypatch.setattr(simhash, "COPY_TILE", tile)
        monkeypatch.setattr(simhash, "SET_SHINGLES", shingles)
        made.clear()
        assert {r.doc_id for r in simhash.one_of_each_group(df).collect()} == set(want.values())
        if shingles == 1 << 21:
            assert max(d.count() for d in made.values()) <= 150 < len(pairs)


def repeated_bytes(texts):
    seen = defaultdict(int)
    for b in texts:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] += 1
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_bytes(df, rows):
    want = [(i, *w) for (i, _), w in zip(rows, repeated_bytes([(t or "").encode() for _, t in rows]))]
    got = [tuple(r) for r in suffix_dedup.drop_repeated_bytes(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeated_bytes(docs, empty, rows):
    check_bytes(docs, rows)
    assert suffix_dedup.drop_repeated_bytes(empty).count() == 0


def test_repeated_bytes_of_spread_anchors(spark, monkeypatch):
    """One passage in many surroundings, with so small shards that its anchors are spread over several."""
    import random

    monkeypatch.setattr(suffix_dedup, "SPREAD", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    from tests_llm_helpers import passages

    rnd, shared = random.Random(5), passages(7, 1, 90)[0]
    rows = []
    for i in range(40):
        cut = rnd.randrange(len(shared) - 250)
        rows.append((i, passages(100 + i, 1, 30)[0] + shared[cut : cut + rnd.randrange(190, 260)] + passages(200 + i, 1, 30)[0]))
    rows.append((99, "ab" * 400))
    check_bytes(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    for data in (rng.integers(97, 99, 400), np.full(300, 97), np.tile(rng.integers(97, 123, 90), 8), np.array([98]), rng.integers(0, 256, 500)):
        data = data.astype(np.uint8)
        whole = data.tobytes()
        order, _ = suffix_dedup.suffix_order(data)
        assert [whole[i : i + 256] for i in order] == sorted(whole[i : i + 256] for i in range(len(whole)))
        got = suffix_dedup.common_prefixes(data, order)
        for k in range(1, len(order)):
            a, b = whole[order[k - 1] :], whole[order[k] :]
            n = 0
            while n < min(len(a), len(b), 200) and a[n] == b[n]:
                n += 1
            assert got[k] == n
        some = order[order % 3 != 1]  # suffixes may be left out; neighbours then share the least of what lies between
        kept = np.flatnonzero(order % 3 != 1)
        assert list(suffix_dedup.common_prefixes(data, some)[1:]) == [min(got[a + 1 : b + 1]) for a, b in zip(kept, kept[1:])]


def test_long_texts_have_the_regions_of_short_ones():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    text, anchor, content, start, n = suffix_dedup._slice_regions([data, data[:300]])
    first = text == 0
    assert list(zip(anchor[first], content[first], start[first], n[first])) == list(suffix_dedup.regions(data))
