"""Near duplicates by SimHash fingerprints, compared exactly in tiles.

A fingerprint takes part in one bucket for each way to choose all but three of a few bit blocks: two
fingerprints that differ in three bits at most agree on one of these choices, so every link lies within a bucket. A
bucket is compared as a tile, or, where it holds more fingerprints than a tile should, as pairs of tiles by
population count and hash: tiles whose population counts differ by more than the radius are never paired. A
tile pair is an exclusive-or of two vectors and a bit count; of its links only a spanning forest is passed on, as
many rows as fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.graph import components
from driftmark.llm.tokens import _ranges
from driftmark.llm.work import bound_batches, give_back, stored

RADIUS = 3
WORDS = 3  # of a shingle
SEED = 42
TILE = 2048  # fingerprints of a tile
COPY_WORDS, COPY_WIDTH, COPY_SIMILARITY = 5, 4, 0.8
COPY_DEVIATIONS = 5  # standard deviations of the bits that differ, beyond which a pair is not compared by its shingles
COPY_TILE = 8192
SET_SHINGLES = 1 << 21  # shingles of a cluster's texts held by a task
BUCKET = 256  # fingerprints a bucket should hold on average, at most
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles in order, SHINGLES_AT_ONCE of them at most in each array."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not found:
        return
    flat = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    starts, ends = starts[:n].tolist(), ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLES_AT_ONCE):
        yield np.array([digest(flat[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES_AT_ONCE], ends[i : i + SHINGLES_AT_ONCE])], "<u8")


def fingerprint(text: str | None, words: int = WORDS, width: int = 1) -> tuple[list[int], int]:
    """width times 64 bits as signed numbers, and the number of shingles; bits are set that over half the hashes have.

    The first 64 bits come from XXH64 of the shingles, the others from remixing it.
    """
    counts, n = np.zeros((width, 64), np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for w in range(width):
            counts[w] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist(), n


def _fingerprints(batches: Iterable[pa.RecordBatch], words: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py(), words, width) for t in batch.column("text")]
        columns = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "bits", "n"])
    give_back()


def fingerprints(docs: DataFrame, words: int = WORDS, width: int = 1) -> DataFrame:
    """(doc_id, row, bits, n) of each row's whole text; a text without words, null too, has bits zero and no shingles.

    row is a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_fingerprints, words=words, width=width), "doc_id long, row long, bits array<long>, n long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which two fingerprints within the radius share one at least; chosen so that buckets stay small."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > BUCKET and blocks < 2 * radius:
        blocks += 1
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    chosen = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value reached) that join what the links a - b join."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _links(node: np.ndarray, bits: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of a group (whose rows are together) by their bits (rows, width).

    Sides 0 and 1 are compared with each other, side 2 with itself.
    """
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(node)))
    ones = np.bitwise_count(bits).sum(1, dtype=np.int16)
    found = []
    small = np.repeat(sizes <= 32, sizes) & (side == 2)
    left = np.repeat(sizes, sizes) - (np.arange(len(node)) - np.repeat(starts, sizes))  # rows from here to the group's end
    for step in range(1, int(sizes[sizes <= 32].max(initial=1))):
        at = np.flatnonzero(small & (left > step))
        near = np.bitwise_count(bits[at] ^ bits[at + step]).sum(1, dtype=np.int16) <= radius
        found.append((node[at[near]], node[at[near] + step]))
    for s, n in zip(starts, sizes):
        if n <= 32 and side[s] == 2:
            continue
        rows = np.arange(s, s + n)
        x, y = (rows, rows) if side[s] == 2 else (rows[side[rows] == 0], rows[side[rows] == 1])
        x, y = x[np.argsort(ones[x], kind="stable")], y[np.argsort(ones[y], kind="stable")]
        for i in range(0, len(x), 128):
            a = x[i : i + 128]
            low, high = np.searchsorted(ones[y], ones[a[0]] - radius), np.searchsorted(ones[y], ones[a[-1]] + radius, "right")
            b = y[low:high]
            apart = np.bitwise_count(bits[a, 0][:, None] ^ bits[b, 0][None, :])
            if bits.shape[1] > 1:  # two words tell almost all pairs apart; the others are counted whole
                apart += np.bitwise_count(bits[a, 1][:, None] ^ bits[b, 1][None, :])
            p, q = np.nonzero(apart <= radius)
            if bits.shape[1] > 1:
                keep = np.bitwise_count(bits[a[p]] ^ bits[b[q]]).sum(1, dtype=np.int16) <= radius
                p, q = p[keep], q[keep]
            keep = node[a[p]] != node[b[q]]
            found.append(_forest(node[a[p[keep]]], node[b[q[keep]]]))
    a, b = (np.concatenate(c) for c in zip(*found)) if found else (node[:0], node[:0])
    return _forest(a, b)


def _compare(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile that goes on in the next batch waits for it."""
    held: list[tuple[np.ndarray, ...]] = []

    def result() -> pa.RecordBatch:
        a, b = _links(*(np.concatenate(c) for c in zip(*held)), radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bits = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        node, side, tile = (batch.column(c).to_numpy() for c in ("node", "side", "tile"))
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut or held and held[-1][3][-1] != tile[0]:
            held.append((node[:cut], bits[:cut], side[:cut], tile[:cut]))
            yield result()
            held = []
        held.append((node[cut:], bits[cut:], side[cut:], tile[cut:]))
    if held:
        yield result()
    give_back()


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the smallest row that each row is joined to) with links a - b added."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _clusters(bits: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For each row of a tile, the smallest row that pairs within the radius join it to."""
    ones = np.bitwise_count(bits).sum(1, dtype=np.int16)
    # The fewest words that tell almost all unrelated pairs, half of whose bits differ, apart; other pairs are counted whole.
    told = next((w for w in range(1, bits.shape[1]) if 32 * w - radius >= 16 * np.sqrt(w)), bits.shape[1])
    root, own = np.arange(len(bits)), side[0] == 2
    x, y = (root, root) if own else (root[side == 0], root[side == 1])
    x, y = x[np.argsort(ones[x], kind="stable")], y[np.argsort(ones[y], kind="stable")]
    for i in range(0, len(x), 128):
        a = x[i : i + 128]
        low, high = np.searchsorted(ones[y], ones[a[0]] - radius), np.searchsorted(ones[y], ones[a[-1]] + radius, "right")
        low = max(low, i) if own else low  # of a side with itself, each row meets the later ones
        b = y[low:high]
        apart = np.bitwise_count(bits[a, 0][:, None] ^ bits[b, 0][None, :])
        for w in range(1, told):
            apart += np.bitwise_count(bits[a, w][:, None] ^ bits[b, w][None, :])
        p, q = np.nonzero(apart <= radius)
        p, q = a[p], b[q]
        untied = root[p] != root[q]
        p, q = p[untied], q[untied]
        near = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int16) <= radius
        root = _merged(root, p[near], q[near])
    return root


def _dealt(root: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, part, side): clusters of several rows, whole up to SET_SHINGLES of weight, else as pairs of their parts."""
    total = np.bincount(root, weight)
    rows = np.flatnonzero(np.bincount(root)[root] > 1)
    whole = total[root[rows]] <= SET_SHINGLES
    yield rows[whole], 0, 2
    for r in np.unique(root[rows[~whole]]):
        own = np.flatnonzero(root == r)
        cut = np.cumsum(weight[own]) // (SET_SHINGLES / 2)
        parts = np.split(own, np.flatnonzero(np.diff(cut)) + 1)
        for i, x in enumerate(parts):
            yield x, i * len(parts) + i, 2
            for j in range(i):
                yield x, i * len(parts) + j, 0
                yield parts[j], i * len(parts) + j, 1


def _compare_copies(batches: Iterable[pa.RecordBatch], radius: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile's rows wait for its last. A size s has texts of up to ratio ** (s + 1) shingles."""
    held: list[tuple[np.ndarray, ...]] = []

    def result() -> Iterator[pa.RecordBatch]:
        node, bits, side, size, tile = (np.concatenate(c) for c in zip(*held))
        starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        for s, e in zip(starts, np.append(starts[1:], len(tile))):
            root = _clusters(bits[s:e], side[s:e], radius)
            for rows, part, at in _dealt(root, ratio ** (size[s:e] + 1.0)):
                if len(rows):
                    alike = [np.full(len(rows), v, t) for v, t in ((tile[s], np.int64), (part, np.int64), (at, np.int32))]
                    columns = [alike[0], node[s:e][root[rows]], alike[1], alike[2], node[s:e][rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tile", "cluster", "part", "side", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bits = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        node, side, size, tile = (batch.column(c).to_numpy() for c in ("node", "side", "size", "tile"))
        if held and held[-1][4][-1] != tile[0]:
            yield from result()
            held = []
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            held.append((node[:cut], bits[:cut], side[:cut], size[:cut], tile[:cut]))
            yield from result()
            held = []
        held.append((node[cut:], bits[cut:], side[cut:], size[cut:], tile[cut:]))
    if held:
        yield from result()
    give_back()


def _shingle_sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["node", "doc_id", "bits", "shingles"]
    for batch in batches:
        for i in range(batch.num_rows):
            found = [np.unique(h) for h in shingle_hashes(batch.column("text")[i].as_py(), words)]
            found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in names[:3]), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names)
    give_back()


def _similar(bits: np.ndarray, side: np.ndarray, flat: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """For each row of a cluster, the smallest row that pairs of the similarity join it to.

    Rows have their sets of shingles in flat, one after another. Rows that are joined already are not compared again.
    """
    root, rows = np.arange(len(bits)), np.arange(len(bits))
    own = side[0] == 2
    x, y = (rows, rows) if own else (rows[side == 0], rows[side == 1])
    ends = np.cumsum(sizes)
    names, flat = np.unique(flat, return_inverse=True)
    marked = np.zeros(len(names), bool)
    for a in x:
        b = y[(root[y] != root[a]) & (y > a)] if own else y[root[y] != root[a]]
        b = b[np.bitwise_count(bits[b] ^ bits[a]).sum(1, dtype=np.int16) <= radius]
        if not len(b):
            continue
        mine = flat[ends[a] - sizes[a] : ends[a]]
        marked[mine] = True
        upto = np.concatenate(([0], np.cumsum(marked[flat[_ranges(ends[b] - sizes[b], sizes[b])]])))
        marked[mine] = False
        stops = np.cumsum(sizes[b])
        common = upto[stops] - upto[stops - sizes[b]]
        b = b[common >= similarity * (sizes[a] + sizes[b] - common)]
        root = _merged(root, np.full(len(b), a), b) if len(b) else root
    return root


def _compare_sets(batches: Iterable[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile, cluster and part; the rows of a part wait for its last."""
    held: list[tuple[np.ndarray, ...]] = []

    def result() -> Iterator[pa.RecordBatch]:
        group, doc_id, bits, side, sizes, flat = (np.concatenate(c) for c in zip(*held))
        starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1))))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        found = []
        for s, e in zip(starts, np.append(starts[1:], len(group))):
            root = _similar(bits[s:e], side[s:e], flat[ends[s] : ends[e]], sizes[s:e], radius, similarity)
            tied = np.flatnonzero(root != np.arange(e - s))
            found.append((doc_id[s:e][tied], doc_id[s:e][root[tied]]))
        a, b = (np.concatenate(c) for c in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("tile", "cluster", "part")], 1)
        bits = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        flat, sizes = batch.column("shingles").flatten().to_numpy(), pc.list_value_length(batch.column("shingles")).to_numpy().astype(np.int64)
        doc_id, side = batch.column("doc_id").to_numpy(), batch.column("side").to_numpy()
        if held and (held[-1][0][-1] != group[0]).any():
            yield from result()
            held = []
        cut = int(np.flatnonzero((group != group[-1]).any(1)).max(initial=-1)) + 1
        at = int(sizes[:cut].sum())
        if cut:
            held.append((group[:cut], doc_id[:cut], bits[:cut], side[:cut], sizes[:cut], flat[:at]))
            yield from result()
            held = []
        held.append((group[cut:], doc_id[cut:], bits[cut:], side[cut:], sizes[cut:], flat[at:]))
    if held:
        yield from result()
    give_back()


def similar_links(clusters: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) of doc_ids that join what pairs within a cluster's part join whose sets of shingles have the similarity (Jaccard).

    clusters is (tile, cluster, part, side, node), texts (node, doc_id, bits, text). Sides 0 and 1 of a part are compared with each
    other, side 2 with itself; only pairs within the radius are.
    """
    shaped = texts.mapInArrow(partial(_shingle_sets, words=words), "node long, doc_id long, bits array<long>, shingles array<long>")
    group = ["tile", "cluster", "part"]
    rows = clusters.join(stored(shaped, "copy-shingles"), "node").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(partial(_compare_sets, radius=radius, similarity=similarity), "a long, b long")


def _tile_pairs(rows: DataFrame, group: list[str], cell: str, reach: int, most: int, one_group: bool = False) -> DataFrame:
    """(tile, side, node, bits, cell): rows (node, bits, group columns, cell) dealt to tiles of about most rows.

    A group of up to most rows is one tile. Of a larger one, each cell is dealt to tiles by hash, and tiles
    are paired if their cells differ by reach at most. one_group tells that the group columns have one value.
    """
    counts = rows.groupBy(*group, cell).count()
    tiles = F.map_from_entries(F.collect_list(F.struct(cell, F.ceil(F.col("count") / most).cast("int"))))
    held = counts.groupBy(*group).agg(F.sum("count").alias("rows"), tiles.alias("tiles")).filter("rows > 1")
    joined = rows.join(F.broadcast(held) if one_group else held, group)  # one row, of one entry per cell

    def named(*parts: Column) -> Column:
        return F.xxhash64(*group, *parts)

    whole = joined.filter(F.col("rows") <= most).select(named().alias("tile"), F.lit(2).alias("side"), "node", "bits", cell)
    own = F.pmod(F.xxhash64("node"), F.try_element_at("tiles", F.col(cell))).cast("int")
    large = joined.filter(F.col("rows") > most).select("*", own.alias("own"))
    others = large.select("*", F.explode(F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col(cell)) <= reach)).alias("e"))
    others = others.select("*", F.explode(F.sequence(F.lit(0), F.col("e.value") - 1)).alias("other"))
    me, it = F.struct(F.col(cell).alias("cell"), "own"), F.struct(F.col("e.key").alias("cell"), F.col("other").alias("own"))
    parted = others.select(named(F.least(me, it), F.greatest(me, it)).alias("tile"), F.when(me == it, 2).when(me < it, 0).otherwise(1).alias("side"), "node", "bits", cell)
    return whole.unionByName(parted)


def linked(tiles: DataFrame, radius: int) -> DataFrame:
    """(node, root) of the nodes that have a link, by components of the links that the tiles hold."""
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    return components(dealt.mapInArrow(partial(_compare, radius=radius), "a long, b long"))


def fingerprint_roots(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of the fingerprints (fp, each once) that have a link."""
    ways = F.array(*(F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(distinct.count(), radius))))
    keyed = distinct.select(F.col("fp").alias("node"), F.array("fp").alias("bits"), F.bit_count("fp").cast("int").alias("ones"), F.explode(ways).alias("w"))
    tiles = _tile_pairs(keyed.select("node", "bits", "ones", "w.way", "w.key"), ["way", "key"], "ones", radius, TILE)
    return linked(tiles.drop("ones"), radius)


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable by links, itself included).

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id have their own
    fingerprints; a row without doc_id takes part, and its component is null only if no row of it has a doc_id.
    Other columns are not read; an empty table gives no rows. Rows of one fingerprint are one node.
    """
    prints = stored(fingerprints(docs, words).select("doc_id", F.get("bits", F.lit(0)).alias("fp")), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    roots = fingerprint_roots(nodes.select("fp"), radius)
    tied = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "rows", "root")
    firsts = tied.filter("root is not null").groupBy("root").agg(F.min("first").alias("component"))
    several = tied.filter("root is not null or rows > 1").join(firsts, "root", "left").select("fp", F.coalesce("component", "first").alias("component"))
    joined = prints.join(several.withColumn("linked", F.lit(True)), "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def copy_radius(similarity: float = COPY_SIMILARITY, width: int = COPY_WIDTH, deviations: float = 0) -> int:
    """Bits that differ between two texts of that similarity of shingles (Jaccard), plus some standard deviations.

    The share of bits that differ estimates the angle between two shingle vectors; of two sets of equal size and
    similarity j, its cosine is 2 j / (1 + j).
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return max(0, int(64 * width * share + deviations * np.sqrt(64 * width * share * (1 - share))))


def one_of_each_group(docs: DataFrame, words: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """docs less all but the smallest doc_id of each group of near copies.

    Two rows are linked if the similarity (Jaccard) of their sets of five-word shingles is 0.8 or more. 256-bit
    fingerprints, compared with room for chance, tell which pairs to look at; the shingles themselves decide. Such rows
    have numbers of shingles that differ by a quarter at most, so they are tiled by size, and only
    tiles of neighbouring sizes are compared. Empty and null texts are one group; rows without doc_id always stay;
    rows that repeat a doc_id stay or go together. All columns are kept; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(-np.log(similarity))).cast("int")
    prints = fingerprints(known, words, COPY_WIDTH).select("doc_id", "row", "bits", size.alias("size"))
    prints = stored(prints, "copy-fingerprints")
    nodes = prints.groupBy("bits", "size").agg(F.min(F.struct("doc_id", "row")).alias("first")).withColumn("node", F.xxhash64("bits", "size"))
    nodes = stored(nodes.select("bits", "size", "node", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")), "copy-nodes")
    tiles = _tile_pairs(nodes.select("node", "bits", "size", F.lit(0).alias("all")), ["all"], "size", 1, COPY_TILE, one_group=True)
    radius = copy_radius(similarity, deviations=COPY_DEVIATIONS)
    compare = partial(_compare_copies, radius=radius, ratio=1 / similarity)
    clusters = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "tile long, cluster long, part long, side int, node long")
    clusters = stored(clusters, "copy-clusters")
    ends = nodes.join(clusters.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "row", "bits")
    texts = known.withColumn("row", F.xxhash64("text")).join(ends, ["doc_id", "row"]).dropDuplicates(["node"]).select("node", "doc_id", "bits", "text")
    # Of two equal texts under one doc_id the node is the same; two texts of one doc_id are one node of the components.
    roots = components(similar_links(clusters, texts, words, similarity, radius))
    linked_ = roots.filter("node != root").select(F.col("node").alias("doc_id"))
    same = prints.join(nodes.select("bits", "size", F.col("doc_id").alias("first")), ["bits", "size"]).filter("doc_id != first").select("doc_id")
    gone = linked_.unionByName(same).distinct().select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
