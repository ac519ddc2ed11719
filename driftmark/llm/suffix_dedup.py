"""Removal of every byte that lies in a string of 200 bytes found elsewhere, by suffix arrays of shards.

Every 200-byte window has an anchor: its 16-byte gram of the smallest hash, the leftmost of equal ones. Equal windows
have equal anchors at equal places, so windows are compared with those of the same anchor only. Neighbouring windows
of a document that share their anchor form a region, the bytes from the first window's start to the last one's end.

1. Regions are named by two 64-bit hashes (anchor, content) without moving any bytes. A region that occurs twice has
   repeated windows only. A region whose anchor occurs in no other region has none.
2. One copy of each other region is cut out of its text and sent to a shard chosen by its anchor. The shard sorts its
   suffixes by Larsson-Sadakane refinement (groups of equal prefixes of 8, 16, ... 256 bytes; sorted ones are left
   alone), takes common prefixes of neighbours by Kasai's rule, and finds the windows that occur twice.
3. An anchor of too many regions for one shard is spread over several by region. Each of these also passes on its
   distinct windows as sorted digests, which are dealt by digest and looked up in one another by binary search.

Rows are counted per region before they are shuffled, and joins on regions may be split by adaptive execution.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tokens import slices
from driftmark.llm.work import stored

WINDOW = 200
GRAM = 16
SHARD_BYTES = 2 << 20  # of regions, about
SPREAD = 2000  # regions of one anchor that a shard may hold
SLICE_BYTES = 1 << 20  # of text whose anchors are found at once
PLACE = ["doc_id", "row"]  # tells rows apart; rows of equal id and text are alike in every respect
REGIONS = "doc_id long, row long, anchor long, content long, start long, n int"
PIECES = "doc_id long, row long, start long, anchor long, content long, n int, copies long, shard int, spread boolean, data binary"
FOUND = "doc_id long, row long, s long, e long, d1 long, d2 long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each byte of data on."""
    n = len(data) - GRAM + 1
    padded = np.ascontiguousarray(data)
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 8, 8), (1, 1)).copy().view("<u8")[:, 0]
    a, b = words[:n] * np.uint64(0x9E3779B185EBCA87), words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (a ^ (a >> np.uint64(29))) + (b ^ (b >> np.uint64(32)))
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of the anchor of the window that starts at each byte; data is shorter than 16 MiB."""
    keys = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, least = 1, keys
    wanted = WINDOW - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(keys) - wanted + 1], least[wanted - width :])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def regions(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, content, start, number of windows) of the regions of one text, in order."""
    piece = 8 << 20
    held: list[int] | None = None  # an anchor's windows may go on in the next piece
    for begin in range(0, max(0, len(data) - WINDOW + 1), piece):
        part = np.frombuffer(data, np.uint8, min(len(data) - begin, piece + WINDOW - 1), begin)
        hashes = gram_hashes(part)
        at = anchors(part, hashes)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        stops = np.append(starts[1:], len(at))
        named = hashes[at[starts]].view(np.int64)
        for s, e, place, name in zip((starts + begin).tolist(), (stops + begin).tolist(), (at[starts] + begin).tolist(), named.tolist()):
            if held and held[0] == place:
                held[3] = e
            else:
                if held:
                    yield _named(data, held)
                held = [place, name, s, e]
    if held:
        yield _named(data, held)


def _named(data: bytes, held: list[int]) -> tuple[int, int, int, int]:
    place, anchor, start, stop = held
    digest = xxhash.xxh3_64_intdigest(data[start : stop + WINDOW - 1], place - start)
    return anchor, digest - (1 << 64) if digest >> 63 else digest, start, stop - start


def _slice_regions(datas: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor, content, start, n) of the regions of short texts, all found at once."""
    joined = np.frombuffer(b"".join(datas), np.uint8)
    sizes = np.array([len(d) for d in datas], np.int64)
    firsts = np.cumsum(sizes) - sizes
    if len(joined) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = gram_hashes(joined)
    at = anchors(joined, hashes)
    text = np.repeat(np.arange(len(datas)), sizes)[: len(at)]
    inside = np.arange(len(at)) + WINDOW <= (firsts + sizes)[text]
    begins = inside & np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    starts = np.flatnonzero(begins)
    n = np.add.reduceat(inside.astype(np.int64), starts) if len(starts) else starts
    whole, places = joined.tobytes(), at[starts]
    digest = xxhash.xxh3_64_intdigest
    content = np.array([digest(whole[s : s + k + WINDOW - 1], p - s) for s, k, p in zip(starts.tolist(), n.tolist(), places.tolist())], np.uint64).view(np.int64)
    return text[starts], hashes[places].view(np.int64), content, starts - firsts[text[starts]], n


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(a, b - a)
            datas = [t.as_py() for t in part.column("text")]
            if len(datas) == 1 and len(datas[0]) > 8 << 20:
                rows = list(regions(datas[0]))
                text, (anchor, content, start, n) = np.zeros(len(rows), np.int64), (np.array(c, np.int64) for c in zip(*rows))
            else:
                text, anchor, content, start, n = _slice_regions(datas)
            if len(text):
                take = pa.array(text)
                columns = [part.column("doc_id").take(take), part.column("row").take(take), pa.array(anchor), pa.array(content), pa.array(start), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in REGIONS.split(", ")])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted regions of each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            data, wanted = batch.column("text")[i].as_py(), batch.column("wanted").slice(i, 1).flatten()
            wanted = pa.RecordBatch.from_struct_array(wanted)
            for j in range(0, wanted.num_rows, 4096):
                some = wanted.slice(j, 4096)
                found = [data[s : s + n + WINDOW - 1] for s, n in zip(some.column("start").to_pylist(), some.column("n").to_pylist())]
                keys = [pa.array([batch.column(c)[i].as_py()] * len(found), pa.int64()) for c in PLACE]
                yield pa.RecordBatch.from_arrays([*keys, *some.columns, pa.array(found, pa.binary())], [c.split()[0] for c in PIECES.split(", ")])


def byte_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy()
    return words.view(">u8")[:, 0].astype(np.uint64)


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of data up to 256 bytes deep, and each suffix's rank; suffixes equal that far share a rank.

    Suffixes in groups of one are sorted and take no part in later rounds.
    """
    n = len(data)
    first = byte_words(data)
    order = np.argsort(first)  # the order of equal ones is of no account
    new = np.concatenate(([True], first[order[1:]] != first[order[:-1]]))
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    rank = np.empty(n, np.int64)
    rank[order] = heads
    depth = 8
    while depth < 256:
        size = np.diff(np.append(np.flatnonzero(new), n))
        many = np.repeat(size > 1, size)
        places = np.flatnonzero(many)
        if not len(places):
            break
        suffix = order[places]
        after = np.where(suffix + depth < n, rank[np.minimum(suffix + depth, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + after
        turn = np.argsort(key)
        order[places], key = suffix[turn], key[turn]
        # Places of a group are together, and groups stay in their places, so only heads inside groups are new.
        new[places[1:]] |= key[1:] != key[:-1]
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[places]] = heads[places]
        depth *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Length (most at most) of the prefix that each suffix of order shares with the one before it; order may leave suffixes out.

    Kasai's rule: where a suffix and its neighbour are preceded by the same byte, the length is one less than that of the
    suffix one byte earlier. Only the other suffixes are compared, eight bytes a time.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (data[:-1] == data[np.maximum(before[1:] - 1, 0)])
    open_ = np.flatnonzero(~carried & (before >= 0))
    words = byte_words(data)
    length = np.zeros(n, np.int64)
    reach = 4 * most  # carried lengths shrink by one a byte, so irreducible ones are followed further
    while len(open_):
        x, y = open_ + length[open_], before[open_] + length[open_]
        room = n - np.maximum(x, y)
        ok = (room > 0) & (length[open_] < reach)
        open_, x, y, room = open_[ok], x[ok], y[ok], room[ok]
        differ = words[x] ^ words[y]
        run = np.zeros(len(open_), np.int64)
        for bits in range(0, 64, 8):
            run += differ < np.uint64(1 << bits)
        run = np.minimum(run, room)
        length[open_] += run
        open_ = open_[run == 8]
    i = np.arange(n)
    last = np.maximum.accumulate(np.where(carried, 0, i))
    # A length carried over more bytes than was followed is compared anew at its end.
    plcp = np.maximum(length[last] - (i - last), 0)
    doubt = np.flatnonzero(carried & (length[last] >= reach) & (plcp < most))
    for j in range(0, len(doubt), 1 << 16):
        some = doubt[j : j + (1 << 16)]
        at = np.arange(most)
        x, y = some[:, None] + at, before[some][:, None] + at
        same = (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        plcp[some] = np.cumprod(same, axis=1).sum(1)
    return np.minimum(plcp[order], most)


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of a shard's regions, and digests of the distinct windows of spread anchors."""
    # Rows of one doc_id and text cut the same region out twice.
    rows = rows.drop_duplicates(["anchor", "content"]).sort_values(["anchor", "content"]).reset_index(drop=True)
    sizes = rows["data"].map(len).to_numpy()
    data = np.frombuffer(b"".join(rows["data"]), np.uint8)
    firsts = np.cumsum(sizes) - sizes
    region = np.repeat(np.arange(len(rows)), sizes)
    offset = np.arange(len(data)) - firsts[region]
    window = offset < rows["n"].to_numpy()[region]
    order, _ = suffix_order(data)
    windows = order[window[order]]
    run = np.cumsum(common_prefixes(data, windows) < WINDOW)
    heads = np.concatenate(([True], run[1:] != run[:-1]))
    group = np.cumsum(heads) - 1
    repeated = np.zeros(len(data), bool)
    repeated[windows] = (np.bincount(group) > 1)[group]
    once, out = rows["copies"].to_numpy() == 1, []
    places = list(zip(rows["doc_id"], rows["row"], rows["start"].to_numpy()))
    for i in np.flatnonzero(once):
        mine = repeated[firsts[i] : firsts[i] + rows["n"][i]]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
        doc_id, row, start = places[i]
        out += [(doc_id, row, int(start + a), int(start + b) - 1 + WINDOW, None, None) for a, b in zip(edges[::2], edges[1::2])]
    whole = data.tobytes()
    spread = rows["spread"].to_numpy()
    for p in windows[heads & spread[region[windows]]].tolist():
        i = region[p]
        digest = np.frombuffer(xxhash.xxh3_128_digest(whole[p : p + WINDOW]), "<i8")
        doc_id, row, start = places[i]
        settled = repeated[p] or not once[i]
        at = int(start + offset[p])
        out.append((doc_id, row, *((None, None) if settled else (at, at + WINDOW)), int(digest[0]), int(digest[1])))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")]).astype("Int64")


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are; of the digests, which come in order, the unsettled windows whose digest is there twice."""
    held: list[pa.RecordBatch] = []
    places = ["doc_id", "row", "s", "e"]

    def found(digests: pa.Table) -> list[pa.RecordBatch]:
        d1, d2 = digests.column("d1").to_numpy(), digests.column("d2").to_numpy()
        # Sorted by d1, then d2; each digest's neighbours are found by binary search within those of equal d1.
        low, high = np.searchsorted(d1, d1, "left"), np.searchsorted(d1, d1, "right")
        twice = high - low > 1
        for i in np.flatnonzero(twice):
            twice[i] = np.searchsorted(d2[low[i] : high[i]], d2[i], "right") - np.searchsorted(d2[low[i] : high[i]], d2[i]) > 1
        rows = digests.select(places).filter(pa.array(twice))
        return rows.filter(rows.column("s").is_valid()).to_batches()

    for batch in batches:
        spans = batch.column("d1").is_null()
        yield batch.select(places).filter(spans)
        digests = batch.filter(pc.invert(spans))
        if not digests.num_rows:
            continue
        table = pa.Table.from_batches([*held, digests])
        d1 = table.column("d1").to_numpy()
        cut = int(np.searchsorted(d1, d1[-1]))
        yield from found(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from found(pa.Table.from_batches(held))


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, gone in zip(batch.column("doc_id"), batch.column("text"), batch.column("gone")):
            data, kept, at, removed, spans = text.as_py(), hashlib.sha256(), 0, 0, 0
            view = memoryview(data)
            end = -1
            for s, e in sorted((g["s"], g["e"]) for g in gone.as_py() or ()):
                if s > end:
                    kept.update(view[at:s])
                    spans += 1
                removed += max(0, e - max(s, end))
                end = max(end, e)
                at = end
            kept.update(view[at:])
            out.append((doc_id.as_py(), len(data), removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, row, s, e): bytes that go, in spans that may overlap; texts has doc_id, row and text (binary)."""
    named = ["anchor", "content"]
    places = texts.mapInArrow(_find, REGIONS)
    common = places.groupBy("anchor").agg(F.count("*").alias("places"), F.min("content").alias("low"), F.max("content").alias("high"))
    # Written first, so that the join has an exchange of its own, whose large partitions can be split.
    common = stored(common.filter("places > 1").select("anchor", (F.col("low") != F.col("high")).alias("contested")), "common-anchors")
    places = stored(places.join(common, "anchor"), "common-regions")
    columns = ["n", "contested", *PLACE, "start"]
    # All any_value of one row's columns see the rows in the same order, so they name one place.
    kinds = stored(places.groupBy(*named).agg(F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in columns)), "region-kinds")
    whole = places.join(kinds.filter("copies > 1").select(*named), named).select(*PLACE, F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + WINDOW).alias("e"))

    contested = kinds.filter("contested")
    total = contested.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    many = contested.groupBy("anchor").count().filter(F.col("count") > SPREAD).select("anchor", F.lit(True).alias("spread"))
    wanted = contested.join(many, "anchor", "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
    shard = F.pmod(F.when(F.col("spread"), F.xxhash64(*named)).otherwise(F.xxhash64("anchor")), F.lit(shards)).cast("int")
    by_text = wanted.groupBy(*PLACE).agg(F.collect_list(F.struct("start", *named, "n", "copies", shard.alias("shard"), "spread")).alias("wanted"))
    cut = _joined(texts, by_text, "inner").select(texts["doc_id"], texts["row"], "text", "wanted")
    found = cut.mapInArrow(_cut, PIECES).groupBy("shard").applyInPandas(_shard, FOUND)
    key = F.coalesce("d1", F.xxhash64("doc_id", "row", "s"))
    met = found.withColumn("key", key).repartition("key").sortWithinPartitions("d1", "d2").drop("key").mapInArrow(_meet, "doc_id long, row long, s long, e long")
    return whole.unionByName(met)


def _joined(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    return texts.join(other, texts["doc_id"].eqNullSafe(other["doc_id"]) & (texts["row"] == other["row"]), how)


def drop_repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that lies in a 200-byte string which also starts anywhere else, in the same row or another. Null texts
    are empty; texts under 200 bytes stay whole; copies of a row, under the same doc_id too, go whole if they are long enough.
    Null doc_ids are places like any other. Other columns are not read; an empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("row"), text.alias("text"))
    spans = repeated_spans(texts).groupBy(*PLACE).agg(F.collect_set(F.struct("s", "e")).alias("gone"))
    return _joined(texts, spans, "left").select(texts["doc_id"], "text", "gone").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
