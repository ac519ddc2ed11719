"""Byte-level BPE from a tokenizer file: encoding by a segment tree over adjacent pairs, decoding by a table of bytes.

A text is split at the file's added tokens, then into words by the vocabulary's pattern; merges never cross words. In
a word, each leaf of the tree holds the rank and place of the pair that begins there, an inner node the least of its
two children, so the root names the leftmost pair of the lowest rank. A merge changes three leaves at most, each
in as many steps as the tree has levels, until the root holds no mergeable pair. A word of n bytes takes
n log n steps whatever it holds.

Most words of a corpus repeat, so texts are first cut into segments, which the pattern and the tree see once each:
before a space that has a character other than white space behind it, and before a line feed that has one ahead of it. The pattern
begins a word at all such places, whatever stands around them. Segments and words that were met are remembered, up to a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tokens import _ranges, slices
from driftmark.llm.work import give_back

NONE = 1 << 62  # of a leaf: no mergeable pair begins here
REMEMBERED = 300_000  # words and segments; beyond it all are forgotten
REMEMBERED_BYTES = 64  # of a word or segment; longer ones are not remembered
SHORT = 64  # bytes of a word whose tree is worked on together with many others
LEAVES = 1 << 18  # of the trees worked on together
SLICE_BYTES = 2 << 20  # text handled at once


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters are themselves, all others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Bytes that begin no white space: ASCII marks, digits and letters, and lead bytes without white space in their block.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of non-null strings one after another, and the number of segments of each text."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts, np.zeros(0, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    first, second = data[:-1], data[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[:-2] = (first == 0x20) & SOLID[second]
    cut[1:-1] |= (second == 0x0A) & (first > 0x20) & (first < 0x7F)
    cut[bounds] = True
    starts = np.flatnonzero(cut)
    # An empty text has no segment; the end of the last text begins none.
    counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]), counts


class PairTree:
    """The least (rank, place) of a row of places, with updates of single places."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        self.least = least = [NONE] * (2 * self.size)
        for i, rank in enumerate(ranks):
            if rank is not None:
                least[self.size + i] = rank * self.size + i
        for i in range(self.size - 1, 0, -1):
            a, b = least[2 * i], least[2 * i + 1]
            least[i] = a if a < b else b

    def root(self) -> int | None:
        """The place of the leftmost lowest rank."""
        found = self.least[1]
        return None if found == NONE else found % self.size

    def put(self, place: int, rank: int | None) -> None:
        least, at = self.least, self.size + place
        new = NONE if rank is None else rank * self.size + place
        while least[at] != new:
            least[at] = new
            at >>= 1
            if not at:
                break
            a, b = least[2 * at], least[2 * at + 1]
            new = a if a < b else b


class PairTrees:
    """Trees of many short words, each a row of arrays; every row with a mergeable pair merges one at a time, all rows at once."""

    def __init__(self, coder: MergeCoder, words: list[bytes]):
        self.coder = coder
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.leaves = 1 << max(1, int(self.lengths.max()) - 1).bit_length()
        rows, size = len(words), self.leaves
        #: ids by place; place size stands for both ends and never has an id
        self.ids = np.full((rows, size + 1), -1, np.int64)
        places = np.arange(size + 1)
        self.ids[places < self.lengths[:, None]] = coder.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        self.after = np.where(places[:size] + 1 < self.lengths[:, None], places[:size] + 1, size)
        self.before = np.broadcast_to(np.concatenate(([size], places[: size - 1])), (rows, size)).copy()
        self.least = np.full((rows, 2 * size), NONE, np.int64)
        self.least[:, size:] = self._leaf(self.ids[:, :-1], self.ids[:, 1:], places[:size])
        for first in (1 << i for i in reversed(range(size.bit_length() - 1))):
            self.least[:, first : 2 * first] = self.least[:, 2 * first : 4 * first].reshape(rows, first, 2).min(2)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.coder.rank_of(left, right)
        return np.where(rank < 0, NONE, rank * self.leaves + place)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of each word's ids."""
        ids, after, before, least, size = self.ids, self.after, self.before, self.least, self.leaves
        row = np.flatnonzero(least[:, 1] != NONE)
        while len(row):
            found = least[row, 1]
            place = found % size
            taken = after[row, place]
            right, left = after[row, taken], before[row, place]
            ids[row, place] = self.coder.merged[found // size]
            ids[row, taken] = -1
            after[row, place] = right
            inner = right < size
            before[row[inner], right[inner]] = place[inner]
            least[row, size + taken] = NONE
            least[row, size + place] = self._leaf(ids[row, place], ids[row, right], place)
            inner = left < size
            least[row[inner], size + left[inner]] = self._leaf(ids[row[inner], left[inner]], ids[row[inner], place[inner]], left[inner])
            rows = np.concatenate((row, row, row[inner]))
            node = np.concatenate((taken, place, left[inner])) + size
            while node[0] > 1:  # all leaves are on one level
                node >>= 1
                least[rows, node] = np.minimum(least[rows, 2 * node], least[rows, 2 * node + 1])
            row = row[least[row, 1] != NONE]
        kept = ids >= 0
        return ids[kept], kept.sum(1)


class MergeCoder:
    """Encodes and decodes with one tokenizer file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, split = content["model"], content["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or content["normalizer"] or model["ignore_merges"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocabulary = model["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        #: (left id, right id) as one number -> rank, and rank -> id of the merged pair
        self.ranks = {vocabulary[a] << 32 | vocabulary[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.pairs = np.array(sorted(self.ranks) or [-1], np.int64)
        self.pair_ranks = np.array([self.ranks.get(pair, -1) for pair in self.pairs.tolist()], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.of_byte = np.array([vocabulary[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.added = {x["content"]: x["id"] for x in content["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in content["added_tokens"]):
            raise ValueError(f"added tokens that take in their neighbours: {path}")
        stops = "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.stops = regex.compile(f"({stops})") if stops else None
        self.words = regex.compile(pattern)
        pieces: dict[int, bytes] = {i: bytes(letters[c] for c in piece) for piece, i in vocabulary.items() if all(c in letters for c in piece)}
        pieces |= {i: text.encode() for text, i in self.added.items()}
        sizes = np.zeros(max(pieces) + 1, np.int64)
        for i, piece in pieces.items():
            sizes[i] = len(piece)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(pieces[i] for i in sorted(pieces)), np.uint8)
        self.cuts = not any(c.isspace() for text in self.added for c in text)
        self.known: dict[str, bytes] = {}  # ids of segments and words; a word is a segment by itself

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 for those that never merge or lack one."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, ranks = len(ids), self.ranks.get
        tree = PairTree([ranks(ids[i] << 32 | ids[i + 1]) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while n > 1 and (place := tree.root()) is not None:
            taken = after[place]
            ids[place] = int(self.merged[ranks(ids[place] << 32 | ids[taken])])
            ids[taken] = -1
            right, left = after[taken], before[place]
            after[place] = right
            if taken < n - 1:
                tree.put(taken, None)
            if right < n:
                before[right] = place
                tree.put(place, ranks(ids[place] << 32 | ids[right]))
            else:
                tree.put(place, None)
            if left >= 0:
                tree.put(left, ranks(ids[left] << 32 | ids[place]))
        return [i for i in ids if i >= 0]

    def _merged_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        found, short = {}, []
        for word in words:
            content = word.encode()
            if len(content) > SHORT:
                found[word] = np.array(self.merge(content), "<u4").tobytes()
            else:
                short.append((len(content), content, word))
        short.sort()
        first = 0
        while first < len(short):
            # Words of like lengths together: LEAVES bounds the rows times the longest one's tree.
            leaves = 1 << max(1, short[first][0] - 1).bit_length()
            some = [x for x in short[first : first + LEAVES // leaves] if x[0] <= leaves]
            first += len(some)
            ids, sizes = PairTrees(self, [content for _, content, _ in some]).merge()
            coded, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            for (_, _, word), start, end in zip(some, [0, *ends], ends):
                found[word] = coded[start:end]
        return found

    def _code(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of distinct segments."""
        get, added, find = self.known.get, self.added, self.words.findall
        if self.stops:
            split = self.stops.split
            parts = [find(x) if len(p := split(x)) == 1 else [w for i, y in enumerate(p) for w in ([y] if i % 2 else find(y))] for x in texts]
        else:
            parts = [find(x) for x in texts]
        found = {word: get(word) for words in parts for word in words}
        found |= {word: np.array([added[word]], "<u4").tobytes() for word in found.keys() & added.keys()}
        found |= self._merged_words([word for word, ids in found.items() if ids is None])
        coded = {x: b"".join([found[w] for w in words]) for x, words in zip(texts, parts)}
        for some in (found, coded):
            if len(self.known) + len(some) > REMEMBERED:
                self.known = {}
            self.known |= {x: ids for x, ids in some.items() if len(x) <= REMEMBERED_BYTES and x not in added}
        return coded

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self._code([text])[text]

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """encode() of many texts, null ones empty: binary values."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return pa.array([self.encode(x) for x in texts.to_pylist()], pa.large_binary())
        parts, counts = segments(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        each = list(map(self.known.get, distinct))
        missing = [i for i, ids in enumerate(each) if ids is None]
        for i, ids in zip(missing, self._code([distinct[i] for i in missing]).values()):
            each[i] = ids
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        which = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(each), "<u4")[_ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        ends = np.concatenate(([0], np.cumsum(sizes[which])))[np.concatenate(([0], np.cumsum(counts)))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        found = found[found < len(self.sizes)]
        return self.bytes[_ranges(self.starts[found], self.sizes[found])].tobytes().decode("utf-8", "replace")


@cache
def _coder(path: str) -> MergeCoder:
    """One per Python worker and file."""
    return MergeCoder(path)


def _encode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(texts, SLICE_BYTES):
            ids = _coder(path).encode_all(texts.slice(a, b - a)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], ["doc_id", "ids"])
    give_back()


def _decode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        for a, b in slices(ids, SLICE_BYTES):
            some = ids.slice(a, b - a)
            texts = [_coder(path).decode(x or b"") for x in some.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), some, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
    give_back()


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text): ids as little-endian unsigned 32-bit integers.

    Null texts are empty and have no ids. Repeated rows are coded each; null doc_ids stay; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(partial(_encode, path=path or default_path()), "doc_id long, ids binary")


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids) as encoded() gives them; null ids are empty."""
    narrow = coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary"))
    return narrow.mapInArrow(partial(_decode, path=path or default_path()), "doc_id long, ids binary, text string")
