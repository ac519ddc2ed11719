"""Benchmark passages in documents: q-gram lemma filtering and banded alignment.

Case, punctuation and white space are set aside: a text becomes its lower-case letters and digits with one space
for each run of anything else. A passage is found if it holds a segment of a benchmark item with edits of a tenth of its
characters at most. Segments begin at every word and are 13 words, or 80 characters where that is less; more of
80 characters lie on a grid of 40 and at each character of words without end. A segment of m
characters with at most k edits shares at least m + 1 - q (k + 1) of its q-grams with the document, all on diagonals
(place in the document less place in the segment) that differ by k at most. So shared q-grams are counted
in overlapping bands of 2k diagonals, of items first and then of the segments of the items that are left; bands that
reach the bound are kept, which loses no match, and the segment is
aligned in each of them by dynamic programming along the band's diagonals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.chars import code_points, folded, grams
from driftmark.llm.tokens import slices
from driftmark.llm.work import bound_batches, give_back

Q = 8
WORDS = 13  # of a segment
SEGMENT, STRIDE = 80, 40  # its characters, at most; from one to the next of those that begin anywhere
LONG_WORD = 20  # characters; of a longer one, each character begins a segment
LEAST_ITEM = 10  # characters
EDITS = 0.1  # of a segment's characters
LEAST_SHARED = 3  # q-grams that a match shares; segments of 24, 25, 32, 33, 40 and 41 characters have an edit fewer for it
AT_ONCE = 1 << 20  # shared q-grams of segments that are counted at once, about
BLOCK_CHARS = 400_000  # of benchmark text that is compared in one pass over the documents
SLICE_BYTES = 1 << 20  # of document text looked up at once
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters, digits and single spaces of text, and where in the text each of them is."""
    points = folded(code_points(text), digits=True)
    at = np.flatnonzero((points != 32) | np.concatenate(([False], points[:-1] != 32)))
    return points[at], at


def segments_of(points: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the segments of an item."""
    n = len(points)
    spaces = np.flatnonzero(points == 32)
    starts, ends = np.append(0, spaces + 1).tolist(), np.append(spaces, n).tolist()
    if n <= SEGMENT and len(starts) <= WORDS:
        return [(0, n)]
    found = {(a, min(a + SEGMENT, ends[w + WORDS - 1] if w + WORDS <= len(ends) else n + 1)) for w, a in enumerate(starts)}
    anywhere = {*range(0, n, STRIDE), n - SEGMENT, *(c for a, b in zip(starts, ends) if b - a > LONG_WORD for c in range(a, b))}
    return sorted({(a, b) for a, b in found | {(a, a + SEGMENT) for a in anywhere} if a >= 0 and b <= n})


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class Index:
    """The segments of a block of items and their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items, self.segments, keys, item, place = [], [], [], [], []
        first, owners, least, n = [], [], [], 0  # of segments; of all q-grams of items, the segments that hold them
        for item_id, text in items:
            points = plain(text.strip())[0]
            points = points[: len(points) - 1] if len(points) and points[-1] == 32 else points
            if len(points) < LEAST_ITEM:
                continue
            own = segments_of(points)
            keys.append(grams(points, Q))
            place.append(np.arange(len(keys[-1])))
            item.append(np.full(len(keys[-1]), len(least)))
            for start, end in own:
                owners.append((np.arange(n + start, n + end - Q + 1), np.full(max(0, end - start - Q + 1), len(self.segments))))
                self.segments.append(points[start:end])
                self.items.append(item_id)
                first.append(start)
            n += len(keys[-1])
            least.append(min(int(self._bounds(np.array([e - s for s, e in own]))[1].min()), 1 << 30))
        self.sizes = np.array([len(s) for s in self.segments], np.int64)
        self.first = np.array(first, np.int64)
        self.edits, self.least = self._bounds(self.sizes)
        self.item_least = np.array(least, np.int64)
        self.letters = np.zeros((len(self.segments), SEGMENT), np.uint32)
        for i, s in enumerate(self.segments):
            self.letters[i, : len(s)] = s
        if keys:
            keys, self.gram_item, self.gram_place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
            self.reach = int(self.gram_place.max()) + 1
            held, owner = (np.concatenate(c) for c in zip(*owners))
            self.owner = owner[np.argsort(held, kind="stable")]
            self.owned = np.bincount(held, minlength=n)
            self.owner_starts = np.cumsum(self.owned) - self.owned
            self.posting = np.argsort(keys, kind="stable")
            self.keys, self.starts = np.unique(keys[self.posting], return_index=True)
            self.counts = np.diff(np.append(self.starts, len(keys)))
            self.seen = np.zeros(1 << 22, bool)
            self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _bounds(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most edits, and fewest shared q-grams, of segments of these sizes."""
        edits = np.maximum(0, np.minimum((EDITS * sizes).astype(np.int64), (sizes + 1 - LEAST_SHARED) // Q - 1))
        return edits, sizes + 1 - Q * (edits + 1)

    def regions(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, lowest diagonal) of each band that holds enough shared q-grams."""
        width = int(max(1, self.edits.max()))
        found = grams(points, Q)
        at = np.flatnonzero(self.seen[(found >> np.uint64(42)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        hit = self.keys[where] == found[at]
        at, where = at[hit], where[hit]
        at, gram = np.repeat(at, self.counts[where]), self.posting[_runs(self.starts[where], self.counts[where])]
        # Of a segment, all diagonals that count lie in two bands of its item, one after the other.
        bands = int((len(points) + self.reach) // width + 3)
        band = self.gram_item[gram] * bands + (at - self.gram_place[gram] + self.reach) // width
        order = np.argsort(band, kind="stable")
        at, gram, band = at[order], gram[order], band[order]
        names, starts, counts = np.unique(band, return_index=True, return_counts=True)
        follows = np.append(names[1:] == names[:-1] + 1, False)
        enough = counts + np.where(follows, np.append(counts[1:], 0), 0) >= self.item_least[names // bands]
        enough[1:] |= follows[:-1] & enough[:-1].copy()
        kept = np.repeat(enough, counts)
        at, gram, band = at[kept], gram[kept], band[kept]
        # Bands that don't touch share no segment's region, so that they can be counted apart.
        sums = np.cumsum(self.owned[gram])
        new = np.flatnonzero(np.append(True, band[1:] > band[:-1] + 1)) if len(band) else np.zeros(0, np.int64)
        cuts = new[np.flatnonzero(np.diff((sums[new] - self.owned[gram[new]]) // AT_ONCE, prepend=-1))]
        out = [self._of_segments(at[a:b], gram[a:b], width, len(points)) for a, b in zip(cuts, np.append(cuts[1:], len(at)))]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _of_segments(self, at: np.ndarray, gram: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        segment = self.owner[_runs(self.owner_starts[gram], self.owned[gram])]
        at, gram = np.repeat(at, self.owned[gram]), np.repeat(gram, self.owned[gram])
        diagonal = at - (self.gram_place[gram] - self.first[segment]) + SEGMENT  # never negative
        band = diagonal // width
        bands = int(length // width + SEGMENT + 2)
        keyed = np.concatenate([segment * bands + band, segment[band > 0] * bands + band[band > 0] - 1])
        shared, n = np.unique(keyed, return_counts=True)
        segment, band = np.divmod(shared, bands)
        enough = n >= self.least[segment]
        return segment[enough], band[enough] * width - SEGMENT

    def aligned(self, points: np.ndarray, segment: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each region's segment, and the diagonal its alignment ends on (from low)."""
        width = int(max(1, self.edits.max()))
        lanes = 4 * width + 1  # the band and the edits to either side of it
        padded = np.concatenate([np.zeros(SEGMENT + width, np.uint32), points, np.zeros(2 * SEGMENT + lanes, np.uint32)])
        base = low + SEGMENT  # of diagonal low - width, in padded
        seen = padded[base + np.arange(SEGMENT + lanes)[:, None]]  # (characters, regions), as all that follows
        letters = np.ascontiguousarray(self.letters[segment].T)
        cost = np.zeros((lanes, len(segment)), np.int16)
        result, lane = np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
        sizes = self.sizes[segment]
        for i in range(int(sizes.max(initial=0))):
            new = cost + (seen[i : i + lanes] != letters[i])
            new[:-1] = np.minimum(new[:-1], cost[1:] + np.int16(1))
            for j in range(1, lanes):
                np.minimum(new[j], new[j - 1] + np.int16(1), out=new[j])
            cost = new
            done = np.flatnonzero(sizes == i + 1)
            if len(done):
                result[done], lane[done] = cost[:, done].min(0), cost[:, done].argmin(0)
        return result, lane - width

    def matches(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) of each segment's occurrences in points."""
        segment, low = self.regions(points)
        out = []
        for i in range(0, len(segment), 4096):
            s, d = segment[i : i + 4096], low[i : i + 4096]
            edits, lane = self.aligned(points, s, d)
            for j in np.flatnonzero(edits <= self.edits[s]):
                end = int(d[j] + lane[j] + self.sizes[s[j]])
                out.append((int(s[j]), max(0, end - int(self.sizes[s[j]])), min(len(points), end), int(edits[j])))
        return out


def _search(batches: Iterable[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    index = Index(items.value)
    if not index.segments:
        return
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for a, b in slices(texts, SLICE_BYTES):
            parts = [plain(t.as_py() or "") for t in texts.slice(a, b - a)]
            points = np.concatenate([np.append(p, np.uint32(0)) for p, _ in parts]).astype(np.uint32)
            ends = np.cumsum([len(p) + 1 for p, _ in parts])
            found: dict[tuple[int, int], list[int]] = {}
            for segment, start, end, edits in index.matches(points):
                doc = int(np.searchsorted(ends, start + (end - start) // 2, "right"))
                first = ends[doc] - len(parts[doc][0]) - 1
                at = parts[doc][1]
                if not len(at):
                    continue
                start, end = (int(at[min(max(x, 0), len(at) - 1)]) for x in (start - first, end - first - 1))
                key = (doc, index.items[segment])
                old = found.get(key)
                found[key] = [min(old[0], start), max(old[1], end + 1), min(old[2], edits)] if old else [start, end + 1, edits]
            if found:
                rows = [(ids[a + doc].as_py(), item, *span) for (doc, item), span in sorted(found.items(), key=repr)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "start", "end", "edits"]
                )
    give_back()


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of each row of docs and each benchmark item with a passage in it.

    start and end (exclusive) are code points of the text, from the first to the last passage of the item; edits is the
    fewest of its segments. Null and empty texts hold nothing; items of fewer than 10 letters, digits and spaces, null
    ones too, are never found; repeated rows are each reported, null doc_ids as null; equal items under several ids are
    found under each. Empty tables give no rows. Other columns are not read. The benchmark is compared in blocks of
    bounded size, one pass over the documents for each, so what is sent to the executors doesn't grow with it.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for i in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()])
        part = rows.mapInArrow(partial(_search, items=sent), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found
