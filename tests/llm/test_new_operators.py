import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftmark.llm import conversation_trie, merges, part_codes, queries

TURNS = "conv_id long, turn long, role string, text string, key string, parent string, depth long, k long"


def content(role, text):
    return hashlib.sha256((f"{len(role.encode())}:" + role + text).encode()).hexdigest()[:32]


def plain_trie(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, content(role or "", text or ""), role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = own + sum(below[q][0] for q in children[p]), sum(below[q][1] for q in children[p]) or 1
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), below[p][1], below[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def awkward_conversations():
    rnd = random.Random(4)
    rows = []
    for c in range(90):
        n = rnd.choice([1, 1, 2, 3, 4, 5, 8, 9, 12, 13])
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hello", "yes", "no", "é…", ""])) for t in range(n)]
    rows += [(7, None, None, None), (7, None, "user", "no turn"), (11, 3, None, "twice"), (11, 3, None, "twice"), (12, 3, "user", None)]
    rows += [(None, 0, "user", "of no conversation"), (1003, 0, "user", "its base is absent"), (2003, -5, "a", "x" * 300_000), (2003, 7, "user1:", "2")]
    rows += [(5000, t, "user", "all the same") for t in range(70)] + [(5001, t, "user", "all the same") for t in range(70)]
    rows += [(6000 + c, t, "user", "copy") for c in range(40) for t in range(10)]
    return rows


def test_conversation_trie(spark):
    rows = awkward_conversations()
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], TURNS).repartition(5)
    got = conversation_trie.rebuilt_trie(df)
    assert tuple(got.columns) == conversation_trie.NODE
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_conversation_trie_with_hot_keys_split(spark, block):
    """Every key with over a fortieth of the rows counts as heavy: one conversation has half of them."""
    rows = [(r[0], r[1], r[2], r[3]) for r in awkward_conversations()] + [(8000, t, "user", str(t % 3)) for t in range(1200)]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], TURNS)
    got = conversation_trie.rebuilt_trie(df, block, parts=40, min_rows=20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_digests_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS_A_CHUNK", 7)
    ids = {"a": range(-30, 900), "b": [5], "c": range(7)}
    df = spark.createDataFrame([(k, i) for k, v in ids.items() for i in v], "key string, conv_id long").repartition(6)
    got = {r.key: r.ends_sha256 for r in conversation_trie.digests_of_members(df).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}


def test_conversation_trie_of_nothing(spark):
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x", "", "", 0, 0)], TURNS)).count() == 0
    # The one turn is cut off and the base has none: the root alone.
    c = next(c for c in range(100) if zlib.crc32(str(c).encode()) % 9 and c % 5)
    got = conversation_trie.rebuilt_trie(spark.createDataFrame([(c, 1, "user", "x", "", "", 0, 0)], TURNS)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(merges.default_path())


@pytest.fixture(scope="module")
def coder():
    return merges.MergeCoder(merges.default_path())


def ids_of(coded):
    return np.frombuffer(coded, "<u4").tolist()


def hard_texts():
    rnd = random.Random(1)
    alphabet = ["a", "b", "th", "ing", "'s", "'LL", "1", " ", "  ", "\n", "\t", ".", "!", "é", "日", "🎉", "\x85", "\xa0", " ", "　", "<|endoftext|>", "<|", "\0"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 5, 60, 300]))) for _ in range(800)]
    return texts + ["a" * 20_000, "ab" * 3000, " " * 5000, "\n" * 301, "", " ", "\n", "<|endoftext|>", "x <|endoftext|>\n\ny", "<|endoftext|", "naïve café " * 200]


def test_merges_equal_the_library(library, coder):
    texts = hard_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    import pyarrow as pa

    got = coder.encode_all(pa.array([*texts, None])).to_pylist()
    assert got.pop() == b"" and [ids_of(x) for x in got] == want
    assert [ids_of(x) for x in coder.encode_all(pa.array(["pad", *texts]).slice(1)).to_pylist()] == want  # all segments known
    assert [coder.decode(x) for x in got] == [library.decode(ids, skip_special_tokens=False) for ids in want] == texts
    assert ids_of(coder.encode(texts[5])) == want[5]


def test_merges_of_every_character_block(library, coder):
    import pyarrow as pa

    texts = [f"a{chr(i)}b 1{chr(i)}{chr(i)}1 !{chr(i)} x" for i in range(0, 0x30000, 1) if not 0xD800 <= i < 0xE000][::7]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids_of(x) for x in coder.encode_all(pa.array(texts)).to_pylist()] == want


def test_trees_pick_the_leftmost_lowest_rank(coder):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aabthe in") for _ in range(rnd.randint(1, 60))).encode() for _ in range(400)] + [b"a" * n for n in range(1, 60)]

    def plain(word):
        ids = [int(coder.of_byte[b]) for b in word]
        while True:
            ranks = [coder.ranks.get(a << 32 | b) for a, b in zip(ids, ids[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                return ids
            at = ranks.index(min(known))
            ids[at : at + 2] = [int(coder.merged[min(known)])]

    want = [plain(w) for w in words]
    assert [coder.merge(w) for w in words] == want
    flat, sizes = merges.PairTrees(coder, words).merge()
    assert np.split(flat, np.cumsum(sizes)[:-1])[3].tolist() == want[3] and flat.tolist() == [i for w in want for i in w]


def test_memory_of_words_is_bounded(coder, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merges, "REMEMBERED", 50)
    own = merges.MergeCoder(merges.default_path())
    texts = [f"word{i} other{i} " * 3 for i in range(200)]
    for text in texts:
        assert own.encode_all(pa.array([text])).to_pylist() == [coder.encode(text)]
    assert len(own.known) <= 60


def test_bytes_that_are_no_text_become_the_replacement(library, coder):
    ids = [int(coder.of_byte[b]) for b in (0x61, 0xC3, 0x62, 0xF0, 0x9F)]
    assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids) and coder.decode(np.array([9_999_999], "<u4").tobytes()) == ""


def test_merges_of_documents(spark, docs, empty, rows, library):
    got = merges.decoded(merges.encoded(docs))
    assert got.columns == ["doc_id", "ids", "text"]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(((r.doc_id, ids_of(r.ids), r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert merges.decoded(merges.encoded(empty)).count() == 0


def plain_codes(rows, parts=4):
    """By vec_id: code, error, label_error; all vectors sound, of one length, ids distinct."""
    ints = np.array([[int(np.floor(float(x) * 1024)) for x in e] for _, e, _ in rows], object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))[:256]
    width = ints.shape[1] // parts
    books = [ints[order][:, i * width : (i + 1) * width].copy() for i in range(parts)]

    def near(part, book):
        distances = [int(((part - entry) ** 2).sum()) for entry in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(4):
        for i in range(parts):
            cut = ints[:, i * width : (i + 1) * width]
            at = np.array([near(p, books[i])[0] for p in cut])
            books[i] = np.array([cut[at == e].sum(0) // (at == e).sum() if (at == e).any() else books[i][e] for e in range(len(books[i]))], object)
    found = [[near(v[i * width : (i + 1) * width], books[i]) for i in range(parts)] for v in ints]
    errors = [sum(d for _, d in f) for f in found]
    labels = defaultdict(int)
    for (_, _, label), e in zip(rows, errors):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for e, _ in f), d, labels[r[2]], digest) for r, f, d in zip(rows, found, errors)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, n long, pos int, part string, ints string, codes string, error long"


def coded_query(spark, tmp_path, name, rows):
    folder = tmp_path / name
    spark.createDataFrame([(*r, 1, 2, "x", "y", "z", 3) for r in rows], VECTORS).repartition(3).write.parquet(str(folder / "embeddings.parquet"))
    return sorted((tuple(r) for r in queries.op13_part_codes(spark, str(folder)).collect()), key=repr)


def test_part_codes(spark, tmp_path):
    rnd = np.random.default_rng(5)
    sound = [(i * 3 % 1000 - 7, [float(x) for x in np.float32(rnd.normal(0, 0.2, 12))], [None, 1, 2, 3][i % 4]) for i in range(330)]
    sound += [(2000 + i, sound[3][1], 9) for i in range(120)] + [(5000, [0.0] * 12, 1), (5001, [-0.0001] * 12, 1), (None, [0.5] * 12, 2), (5002, [150000.0, -150000.0] * 6, 2)]
    bad = [(-50, None, 1), (-51, [0.1] * 11 + [None], 1), (-52, [float("nan")] * 12, 2), (-53, [float("inf")] + [0.0] * 11, 2), (-54, [], 1), (6000, [0.1] * 8, 1), (-55, [0.1] * 7, 1), (-56, [3e38] * 12, 1)]
    want = plain_codes(sound)
    got = coded_query(spark, tmp_path, "all", sound + bad)
    assert got == want and len({r[1] for r in got}) > 200


def test_part_codes_of_few_vectors(spark, tmp_path):
    rows = [(5, [0.1, 0.2, 0.3, 0.4], None), (6, [0.1, 0.2, 0.3, 0.4], None), (7, [-1.0, -2.0, 0.3, 0.9], 1)]
    assert coded_query(spark, tmp_path, "few", rows) == plain_codes(rows)
    assert coded_query(spark, tmp_path, "none", []) == [] and coded_query(spark, tmp_path, "unsound", [(1, None, 1)]) == []


def test_codes_stand_for_entries(spark):
    books = np.arange(2 * 3 * 2).reshape(2, 3, 2)
    df = spark.createDataFrame([(1, [0, 2]), (2, [1, 1])], "vec_id long, codes array<int>")
    assert {r.vec_id: r.ints for r in part_codes.decoded(df, books).collect()} == {1: [0, 1, 10, 11], 2: [2, 3, 8, 9]}


@pytest.mark.parametrize("n,depth,low,high", [(1, 4, 0, 3), (3000, 4, 0, 5), (3000, 16, -100, 100), (2000, 3, -2, 2), (2000, 5, -(2**26), 2**26), (7, 1, 0, 9)])
def test_the_trie_finds_the_nearest_entry(n, depth, low, high):
    rnd = np.random.default_rng(depth)
    parts, book = np.unique(rnd.integers(low, high, (n, depth)), axis=0), rnd.integers(low, high, (30, depth))
    distances = ((parts[:, None, :] - book) ** 2).sum(2)
    index, error = part_codes.nearest(parts, book)
    assert (index == distances.argmin(1)).all() and (error == distances.min(1)).all()
