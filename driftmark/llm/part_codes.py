"""Vector code compression: each part of a vector is replaced by the index of its nearest codebook entry.

Components are integers, floor(1024 * x), and all sums are exact. Distances are found on a lexicographic trie of
distinct parts: sorted parts are the trie's leaves in depth-first order, and a node holds the distances of all
entries over its prefix, which the parts below share. The traversal goes through a bounded run of leaves at a time,
level by level; where one leaf is left below a node, the rest of its path is added in one product. Leaves take the
least distance, ties to the lower index, and add their components, times the number of their vectors, to their entry.

Codebooks are learned in rounds over a stored table of distinct parts, ordered so that a task's parts share prefixes.
Sums are added up per task, then per entry: what comes to the driver is one codebook's size a round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.work import give_back, stored
from driftmark.operators.skew import lookup_join

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
RUN = 1024  # leaves of the trie worked on together
EXACT = 2.0**53  # integers that a double holds exactly


def integer_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, ints) of rows (vec_id, embedding, label) whose embedding can be coded.

    Left out: null vectors; those with null or non-finite components, or components so large that a squared distance
    between two such vectors passes 64 bits; those whose length isn't a positive multiple of parts. Other columns are not read.
    """
    narrow = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    size = F.size("embedding")
    wide = F.sqrt(F.lit(2.0**60) / size) / SCALE
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < wide, F.lit(False)) & ~F.isnan(x))
    kept = narrow.filter(F.col("embedding").isNotNull()).filter((size > 0) & (size % parts == 0)).filter(sound)
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("ints"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (rows of book, ties to the lower one) and squared distance of distinct parts in lexicographic order."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4.0 * largest * largest * parts.shape[1] < EXACT else np.int64
    book = book.astype(kind)
    for first in range(0, len(parts), RUN):
        found = _descend(parts[first : first + RUN].astype(kind), book)
        index[first : first + RUN] = found.argmin(1)
        error[first : first + RUN] = found.min(1)
    return index, error


def _descend(leaves: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Distances (leaves x entries) of a run of sorted distinct leaves."""
    n, depth = leaves.shape
    out = np.empty((n, len(book)), leaves.dtype)
    # The number of leading dimensions each leaf shares with the one before it.
    differs = leaves[1:] != leaves[:-1]
    shared = np.concatenate(([0], differs.argmax(1))) if n > 1 else np.zeros(1, np.int64)
    live = np.arange(n)  # leaves whose node has others below
    above, node_of = np.zeros((1, len(book)), leaves.dtype), np.zeros(n, np.int64)
    for d in range(depth):
        if not len(live):
            break
        begins = shared[live] <= d
        begins[0] = True
        node = np.cumsum(begins) - 1
        heads = live[begins]
        level = above[node_of[begins]] + (leaves[heads, d, None] - book[:, d]) ** 2
        alone = (np.bincount(node) == 1)[node]
        if alone.any() or d == depth - 1:
            ends = live[alone] if d < depth - 1 else live
            rest, tail = leaves[ends, d + 1 :], book[:, d + 1 :]
            out[ends] = level[node[alone] if d < depth - 1 else node] + (rest * rest).sum(1)[:, None] - 2 * (rest @ tail.T) + (tail * tail).sum(1)
            if d == depth - 1:
                break
        live, node_of, above = live[~alone], node[~alone], level
        # A leaf after one that left is still a node's beginning if the two did not share it.
        shared = _carried(shared, live)
    return out


def _carried(shared: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Prefix lengths shared with the preceding live leaf: the least of those passed on the way."""
    out = shared.copy()
    if len(live) > 1:
        least = np.minimum.reduceat(shared, np.concatenate(([0], live[:-1] + 1)))[1:]
        out[live[1:]] = least
    return out


def _sorted_parts(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the place of each row among them."""
    order = np.lexsort(ints.T[::-1])
    ordered = ints[order]
    new = np.ones(len(ints), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    place = np.empty(len(ints), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _moved(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pos, entry, n, sums) of the distinct parts (pos, part, n), one row per entry that got any."""
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for batch in batches:
        at, n, ints = batch.column("pos").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("part"))
        for pos in np.unique(at):
            leaves, place = _sorted_parts(ints[at == pos])
            weight = np.zeros(len(leaves), np.int64)
            np.add.at(weight, place, n[at == pos])
            entry, _ = nearest(leaves, books[pos])
            np.add.at(counts[pos], entry, weight)
            np.add.at(sums[pos], entry, leaves * weight[:, None])
    pos, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[pos, entry]), pa.array(list(sums[pos, entry]), pa.list_(pa.int64()))],
        ["pos", "entry", "n", "sums"],
    )
    give_back()


def same_length(kept: DataFrame, length: int) -> DataFrame:
    return kept.filter(F.size("ints") == length)


def first_entries(kept: DataFrame, entries: int = ENTRIES) -> np.ndarray | None:
    """Vectors (rows) of the smallest vec_ids, null last, rows of one vec_id in the order of their components.

    A codebook's size of rows comes to the driver. Vectors of another length than the very first one don't count.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    head = kept.orderBy(*order).select(F.size("ints").alias("n")).first()
    if head is None:
        return None
    rows = same_length(kept, head.n).orderBy(*order).select("ints").limit(entries).collect()
    return np.array([r.ints for r in rows], np.int64)


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x dimensions of a part) of integer_vectors(); None where there is none.

    Codebooks begin as the parts of the first vectors. Each round moves each entry to the floor of the mean of the
    parts nearest to it; entries without any stay.
    """
    first = first_entries(kept, entries)
    if first is None:
        return None
    length = first.shape[1]
    width = length // parts
    books = np.stack([first[:, i * width : (i + 1) * width] for i in range(parts)])
    cut = F.array(*[F.slice("ints", i * width + 1, width) for i in range(parts)])
    each = same_length(kept, length).select(F.posexplode(cut).alias("pos", "part"))
    distinct = each.groupBy("pos", "part").agg(F.count("*").alias("n"))
    distinct = stored(distinct.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "distinct-parts")
    for _ in range(rounds):
        moved = distinct.mapInArrow(partial(_moved, books=books), "pos int, entry int, n long, sums array<long>")
        totals = moved.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        books = books.copy()
        for row in totals.collect():
            books[row.pos, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return books


def _code(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = books.shape[2]
    for batch in batches:
        if not batch.num_rows:
            continue
        ints = _matrix(batch.column("ints"))
        codes, errors = np.zeros((len(ints), len(books)), np.int64), np.zeros(len(ints), np.int64)
        for i, book in enumerate(books):
            leaves, place = _sorted_parts(ints[:, i * width : (i + 1) * width])
            entry, error = nearest(leaves, book)
            codes[:, i] = entry[place]
            errors += error[place]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label_key"), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors)],
            ["vec_id", "label_key", "codes", "error"],
        )
    give_back()


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label_key, codes, error) of integer_vectors() of the codebooks' length; label_key tells labels, null among them, apart."""
    label_key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = same_length(kept, books.shape[0] * books.shape[2]).select("vec_id", label_key.alias("label_key"), "ints")
    return rows.mapInArrow(partial(_code, books=books), "vec_id long, label_key string, codes array<int>, error long")


def with_label_errors(found: DataFrame) -> DataFrame:
    """coded() with label_error, the error of all vectors of a label; a label may hold any share of them."""
    per_label = found.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return lookup_join(found, per_label, ["label_key"], "inner", salt_by=["vec_id"])


def hex_code(codes: Column) -> Column:
    """Two hex digits per index."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def decoded(found: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, ints): the vectors that codes stand for, as integers."""
    table = F.from_json(F.lit(str(books.tolist())), "array<array<array<long>>>")
    each = F.transform("codes", lambda c, i: F.get(F.get(table, i), c))
    return found.select("vec_id", F.flatten(each).alias("ints"))


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and place, comma-joined."""
    return ",".join(map(str, books.reshape(-1).tolist()))
