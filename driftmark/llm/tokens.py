"""Token ids of whole texts, with a public tokenizer file and the tokenizers library.

The vocabulary's rules never look across ASCII white space: normalisation works on runs without it and
the split pattern matches none. So a text's ids are the ids of its white-space-free segments one after
another. Each segment the library has encoded is remembered, since most segments of a corpus repeat.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from driftmark.llm.work import give_back

END_ID = 2
#: Lower-case letters that normalising leaves as they are, then ASCII marks: one or two pieces for the vocabulary's rules.
LATIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
SLICE_BYTES = 1 << 21  # text handled at once
CACHE_SEGMENTS = 400_000  # remembered segments per Python worker; beyond it the rarer half is forgotten


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class SegmentEncoder:
    """Encodes texts to one flat array of ids and the number of ids of each text.

    A segment's ids are those of its stem (lower case; one closing full stop or comma after an ASCII
    letter taken off) and the mark's id. Stems of Latin letters only need no normalising and no
    splitting beyond the marks after them, so the library gets many of them at once, separated by spaces;
    the last id of each carries the end-of-word suffix, which tells where a stem's ids end. All other
    stems go through the file's whole chain of rules.
    """

    def __init__(self, path: str | None = None, cache_segments: int = CACHE_SEGMENTS):
        # Tasks are the parallelism; the library's own threads would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.plain = Tokenizer(self.tokenizer.model)  # the vocabulary is shared, not loaded twice
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.marks = np.array([self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,"], np.uint32)
        self.cache_segments = cache_segments
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int64)
        self.used = 0

    def rest(self) -> None:
        """Keep the frequent stems only, between tasks."""
        if len(self.slots) > self.cache_segments // 4:
            self._shrink()

    def _shrink(self) -> None:
        """Forget the stems that were met least often."""
        n = len(self.slots)
        if not n:
            return
        kept = np.flatnonzero(self.hits[:n] > np.median(self.hits[:n]))
        stems = list(self.slots)
        stems = [stems[i] for i in kept]
        ids, sizes, hits = self.ids[_ranges(self.starts[kept], self.sizes[kept])], self.sizes[kept], self.hits[kept]
        self.forget()
        self._add(stems, ids, sizes)
        self.hits[: len(kept)] = hits // 2

    def _add(self, stems: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.slots), len(self.slots) + len(stems)
        while n > len(self.starts):
            self.starts, self.sizes, self.hits = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.hits))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[first:n] = sizes
        self.starts[first:n] = self.used + np.cumsum(sizes) - sizes
        self.hits[first:n] = 0
        self.used += len(ids)
        self.slots.update(zip(stems, range(first, n)))

    def _known(self, stems: list[str]) -> np.ndarray:
        """The slot of each stem, -1 of those not remembered."""
        return np.fromiter(map(self.slots.get, stems, repeat(-1)), np.int64, len(stems))

    def _learn(self, stems: list[str]) -> None:
        plain, pieces, other = [], [], []
        for stem in stems:
            if found := LATIN.fullmatch(stem):
                plain.append(stem)
                pieces.append(found[1] + " " + found[2] if found[2] else stem)
            else:
                other.append(stem)
        for i in range(0, len(plain), 20_000):
            some = pieces[i : i + 20_000]
            joined = [" ".join(some[j : j + 200]) for j in range(0, len(some), 200)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            last = np.cumsum([1 + (" " in piece) for piece in some]) - 1
            self._add(plain[i : i + 20_000], ids, np.diff(np.flatnonzero(self.closes[ids])[last], prepend=-1))
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            self._add(some, np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings, nulls count as empty. Flat ids (uint32) and ids per text (int64)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.ascii_split_whitespace(texts)
        counts = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        words = pc.ascii_lower(coded.dictionary)
        marked = pc.match_substring_regex(words, "[a-z][.,]$")
        cut = pc.ascii_rtrim(words.filter(marked), ".,")
        marked = marked.to_numpy(zero_copy_only=False)
        which = np.arange(len(words))
        which[marked] = len(words) + np.arange(len(cut))
        stemmed = pa.concat_arrays([words, cut]).take(pa.array(which)).dictionary_encode()
        stems = stemmed.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        slot = self._known(stems)
        missing = np.flatnonzero(slot < 0)
        if len(missing) and len(self.slots) + len(missing) > self.cache_segments:
            self._shrink()
            slot = self._known(stems)
            missing = np.flatnonzero(slot < 0)
        if len(missing):
            some = [stems[i] for i in missing.tolist()]
            self._learn(some)
            slot[missing] = self._known(some)
        self.hits[slot] += 1
        slot = slot[stemmed.indices.to_numpy()]
        stem_sizes = self.sizes[slot]
        sizes = stem_sizes + marked
        starts = np.cumsum(sizes) - sizes
        table = np.empty(int(sizes.sum()), np.uint32)
        at = np.ones(len(table), bool)
        ends = (starts + sizes - 1)[marked]
        at[ends] = False
        table[at] = self.ids[_ranges(self.starts[slot], stem_sizes)]
        table[ends] = self.marks[pc.ends_with(words, ",").to_numpy(zero_copy_only=False)[marked].astype(np.int64)]
        word = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[word])))
        stops = np.concatenate(([0], np.cumsum(counts)))
        return table[_ranges(starts[word], sizes[word])], ends[stops[1:]] - ends[stops[:-1]]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with at most limit bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(size):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += int(n)
    if len(size) > first:
        yield first, len(size)


_encoders: dict[str, SegmentEncoder] = {}


def key_of(path: str | None) -> str:
    return path or default_path()


def encoder(path: str | None = None) -> SegmentEncoder:
    """One encoder per Python worker and file, so that later tasks find segments already encoded."""
    key = key_of(path)
    if key not in _encoders:
        _encoders[key] = SegmentEncoder(key)
    return _encoders[key]


def encoded_texts(batches: Iterable[pa.RecordBatch], path: str | None = None, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each slice of the batches (which have a column text) with an id array per row, end_id last."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(texts):
            ids, sizes = encoder(path).encode(texts.slice(a, b - a))
            out = np.empty(len(ids) + len(sizes), np.uint32)
            ends = np.cumsum(sizes + 1)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep], out[ends - 1] = ids, end_id
            yield batch.slice(a, b - a), np.split(out, ends[:-1])
        del batch, texts
        give_back()
    if key_of(path) in _encoders:
        encoder(path).rest()
    give_back()
