import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests_llm_helpers import library_ids

from driftmark.llm import packing, token_files
from driftmark.llm.tokens import SegmentEncoder, encoded_texts


def test_segments_give_the_librarys_ids(rows):
    texts = [t for _, t in rows] + ["it's 3rd's we'll O'Neil's, end.", "á é x y", "İstanbul ΣΑΣ straße", "<|endoftext|> x<|startoftext|>y", "!?.,;a.b.,c", "don't.", "a̸= ≮"]
    encoder = SegmentEncoder(cache_segments=50)
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == library_ids(text)


def test_every_slice_ends_documents(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.string())], ["text"])
    got = [a.tolist() for _, arrays in encoded_texts([batch]) for a in arrays]
    assert got == [library_ids(t) + [2] for _, t in rows]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, (1 << 18) + 3])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 200_000).astype(np.uint32)
    docs = np.split(ids, np.sort(rng.integers(0, n + 1, 3)))
    content = token_files.file_bytes([None, 7, 7, -3], docs)
    doc_ids, back = token_files.file_documents(content)
    assert doc_ids == [None, 7, 7, -3] and [b.tolist() for b in back] == [d.tolist() for d in docs]
    with pytest.raises(ValueError, match="not a whole"):
        token_files.file_documents(content[:-1])


def test_token_files_of_a_table(docs, empty, rows, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "files"), tokens_per_file=3000)
    got = token_files.read_token_files(docs.sparkSession, str(tmp_path / "files"), with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    at = 0
    for (doc_id, text), r in zip(sorted(rows, key=key), got):
        want = library_ids(text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4"))
        at += len(want)
    assert token_files.token_files(empty).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=4, loss_tokens=40, pool=8, least_cut=4, least_sequence=8)])
def test_packing(docs, empty, rows, limits):
    got = packing.pack(docs.select("text", "doc_id", "source"), limits, with_ids=True).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and len(r.ids) == r.length
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
    cut = {}
    for r in got:
        cut.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    want = {}
    for doc_id, text in rows:
        ids = library_ids(text) + [2]
        want.setdefault((doc_id, len(ids)), []).append(ids)
    assert cut.keys() == want.keys()
    for key, texts in want.items():
        pieces = sorted(cut[key])
        assert sum(len(p) for _, p in pieces) == sum(map(len, texts))
        if len(texts) == 1:
            assert [i for _, p in pieces for i in p] == texts[0]
    assert packing.pack(empty, limits).count() == 0


def test_packing_wastes_little(spark):
    from tests_llm_helpers import lengths

    df = spark.createDataFrame(lengths(), "doc_id long, text string").coalesce(2)
    got = packing.pack(df).groupBy("sequence_id").sum("length").collect()
    padded = sum(1 << max(6, (r[1] - 1).bit_length()) for r in got)
    assert padded <= 1.03 * sum(r[1] for r in got)


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "answer words here", "a question"), (2, "reply", None), (3, None, "only asked")], "doc_id long, text string, ask string")
    got = {r.doc_id: r for r in packing.pack(df, prompt="ask", with_ids=True).collect()}
    assert got[1].ids == library_ids("a question") + library_ids("answer words here") + [2]
    assert got[1].loss_tokens == len(library_ids("answer words here")) + 1 and got[3].loss_tokens == 1


def test_stems_that_are_known_are_not_forgotten_and_learned_again(monkeypatch):
    encoder, learned = SegmentEncoder(cache_segments=300), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda stems: (learned.extend(stems), learn(stems)))
    text = pa.array([" ".join(f"stem{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))])
    first, second = encoder.encode(text)[0], encoder.encode(text)[0]
    assert len(learned) == 200 and first.tolist() == second.tolist()


def test_a_known_stem_is_looked_up_once():
    class Counted(dict):
        looks = 0

        def get(self, *a):
            Counted.looks += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.looks += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            Counted.looks += 1
            return super().__contains__(k)

    made, texts = SegmentEncoder(), pa.array(["one two three two, three.", "two"])
    first = made.encode(texts)
    made.slots = Counted(made.slots)
    again = made.encode(texts)
    assert all((x == y).all() for x, y in zip(first, again)) and Counted.looks == 3
