"""Prefix trie of conversations by digests of fixed-length blocks of turns.

A conversation's turns are cut into blocks of BLOCK turns. Conversations are grouped by their successive block
digests first: one row per conversation and block, and of those one row per distinct block at its place in
the trie. Turn boundaries inside a block matter only where blocks diverge: a block that alone continues its
parent has a plain chain of nodes with the block's own counts; blocks with siblings are taken apart and their
turns grouped by the digest of the block's beginning.

A prefix of whole blocks is named by sums, over its blocks, of hashes of (place, block digest). Sums can be
carried along a conversation by a running total, which splits into pieces where one conversation holds a large
share of all turns. Names have 128 bits.

A node's smallest member is its owner. An owner's nodes are the lower end of its own path, so the sum of
anything over a subtree is the sum over its members of what each owns, less what the top's owner owns above the
top. That needs one aggregate over the blocks of the owners' paths and no pass per level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.work import stored
from driftmark.operators.skew import OrderedKeys, lookup_join

BLOCK = 4  # turns
LANES = ("lane_0", "lane_1", "lane_2", "lane_3")
IDS_A_CHUNK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

NODE = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def _name(*parts: Column) -> Column:
    """128 bits of SHA-256 in hex; parts have a fixed width or hold no comma."""
    return F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, 32)


def turns(conversations: DataFrame, **skew) -> DataFrame:
    """(conv_id, pos, digest, n_bytes) of every turn; pos counts from 1 in the order of turn, null first.

    Turns of one number are ordered by their content's digest. Null roles and texts are empty; rows without
    conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    narrow = conversations.select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    known = narrow.filter(F.col("conv_id").isNotNull())
    ordered = OrderedKeys(known, ["conv_id"], ["turn", "digest"], measure=conversations.select(F.col("conv_id").cast("long")).dropna(), **skew)
    return ordered.positions("pos").select("conv_id", "pos", "digest", "n_bytes")


def with_shared_heads(found: DataFrame, **skew) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c of turns(): the first h turns of conversation c - c % 5, then c's own after its first h.

    h is crc32(decimal c) % 9. Returns (conv_id, depth, digest, n_bytes) and all conv_ids, one row each.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    ids = found.filter("pos = 1").select("conv_id")  # pos is unique in a conversation
    bases = found.filter((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).withColumnRenamed("conv_id", "base")
    heads = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(bases, "base").filter(F.col("pos") <= head)
    rows = heads.select("conv_id", F.lit(0).alias("part"), "pos", "digest", "n_bytes").unionByName(
        found.filter(F.col("pos") > head).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "n_bytes")
    )
    ordered = OrderedKeys(rows, ["conv_id"], ["part", "pos"], measure=found.select("conv_id"), **skew)
    return ordered.positions("depth").select("conv_id", "depth", "digest", "n_bytes"), ids


def blocks(sequences: DataFrame, block: int = BLOCK, **skew) -> DataFrame:
    """(conv_id, k, digests, sizes, before, block_id) of each block of sequences (conv_id, depth, digest, n_bytes).

    before names the prefix ahead of the block and block_id the prefix with it, so that block_id of a full block is the
    next one's before. digests and sizes have one entry per turn.
    """
    k = F.expr(f"(depth - 1) div {block}").alias("k")
    rows = sequences.groupBy("conv_id", k).agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "n_bytes"))).alias("held"))
    rows = rows.select("conv_id", "k", F.col("held.digest").alias("digests"), F.col("held.n_bytes").alias("sizes"))
    content = F.array_join("digests", "")
    halves = {}
    for i in range(len(LANES) // 2):
        hashed = F.xxhash64(F.lit(i), "k", content)
        halves[LANES[2 * i]], halves[LANES[2 * i + 1]] = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)
    rows = rows.select("*", *[v.alias(f"own_{n}") for n, v in halves.items()])
    summed = OrderedKeys(rows, ["conv_id"], ["k"], measure=sequences.select("conv_id"), **skew).running_sums({n: F.col(f"own_{n}") for n in LANES})
    before = _name(F.col("k"), *[F.col(n) - F.col(f"own_{n}") for n in LANES])
    after = _name(F.col("k") + 1, *[F.col(n) for n in LANES])
    named = summed.withColumn("before", before)
    block_id = F.when(F.size("digests") == block, after).otherwise(_name(F.col("before"), F.array_join("digests", "")))
    return named.select("conv_id", "k", "digests", "sizes", "before", block_id.alias("block_id"))


def root_name() -> Column:
    return _name(F.lit(0), *[F.lit(0)] * len(LANES))


def _turn_nodes(distinct: DataFrame, block: int, **skew) -> DataFrame:
    """(block_id, alone, key, parent, depth, n_bytes, n_convs, owner) of each turn of each distinct block."""
    siblings = distinct.groupBy("before").agg((F.count("*") == 1).alias("alone"))
    judged = lookup_join(distinct, siblings, ["before"], "inner", salt_by=["block_id"], **skew)
    begun = F.transform(
        F.sequence(F.lit(1), F.size("digests")),
        lambda i: F.when(i == F.lit(block), F.col("block_id")).otherwise(_name(F.col("before"), F.array_join(F.slice("digests", F.lit(1), i), ""))),
    )
    each = judged.withColumn("keys", begun).select("*", F.posexplode("keys").alias("i", "key"))
    parent = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("keys", F.col("i") - 1))
    return each.select(
        "block_id", "alone", "key", parent.alias("parent"), (F.col("k") * block + F.col("i") + 1).alias("depth"),
        F.get("sizes", F.col("i")).alias("n_bytes"), "n_convs", "owner",
    )


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal conv_ids of a key, comma-joined, from rows in the order of (key, conv_id)."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["key", "first", "ids"])

    key, held = None, []
    for batch in batches:
        for now, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (now != key or len(held) == IDS_A_CHUNK):
                yield row()
                held = []
            key = now
            held.append(conv_id)
    if held:
        yield row()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a key's chunks, from rows in the order of (key, first); one chunk is in memory at a time."""
    key, state, done = None, None, []
    for batch in batches:
        for now, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((key, state.hexdigest()))
            key, state = now, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["key", "ends_sha256"])
            done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def digests_of_members(ended: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the ids of a key in numeric order, however many there are.

    Ids are joined in chunks over ordered partitions, so that a hot key's ids are sorted and written out by many tasks; the
    digest itself is sequential and is fed one row per IDS_A_CHUNK ids.
    """
    chunks = ended.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key string, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key string, ends_sha256 string")


def trie(sequences: DataFrame, ids: DataFrame, block: int = BLOCK, **skew) -> DataFrame:
    """Nodes of the trie of sequences (conv_id, depth from 1 without gaps, digest, n_bytes) of the conversations ids.

    A node is a distinct beginning of d turns, the root that of none. Columns: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the node's subtree, (n_convs - 1) times the
    bytes of each node's last text), ends_sha256 (of the ids of members that end here, in order, comma-joined). No
    conversation gives no node, not even the root.
    """
    found = stored(blocks(sequences, block, **skew), "trie-blocks")
    distinct = found.groupBy("block_id").agg(
        F.first("before").alias("before"), F.first("k").alias("k"), F.first("digests").alias("digests"), F.first("sizes").alias("sizes"),
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"),
    )
    turn_nodes = stored(_turn_nodes(stored(distinct, "trie-distinct"), block, **skew), "trie-turns")
    columns = ["key", "parent", "depth", "n_bytes", "n_convs", "owner"]
    chains = turn_nodes.filter("alone").select(columns)
    refined = turn_nodes.filter("NOT alone").groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"),
        F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"),
    )
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0").select(
        root_name().alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), "n_convs", "owner"
    )
    plain = stored(chains.unionByName(refined.select(columns)).unionByName(root), "trie-plain")
    children = plain.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
    nodes = stored(plain.join(children, "key", "left").select(*columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), saved), "trie-nodes")

    leaf = (F.col("n_children") == 0).cast("long")
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"), F.sum(leaf).alias("leaves"))
    per_block = lookup_join(found.select("conv_id", "block_id"), owners, ["conv_id"], "inner", **skew).groupBy("block_id").agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    below = turn_nodes.select("block_id", "key").join(per_block, "block_id").groupBy("key").agg(F.sum("saved").alias("below"), F.sum("leaves").alias("n_leaves"))
    whole = nodes.agg(F.sum("saved").alias("below"), F.sum(leaf).alias("n_leaves")).select(root_name().alias("key"), "below", "n_leaves")
    below = below.unionByName(whole.filter("below IS NOT NULL"))

    above = OrderedKeys(nodes, ["owner"], ["depth"], **skew).running_sums({"upto": F.col("saved")})
    parents = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"))
    placed = lookup_join(above, parents, ["parent"], "left", salt_by=["key"], **skew)
    lasts = found.groupBy("conv_id").agg(F.max_by("block_id", "k").alias("key"))
    ended = stored(ids.join(lasts, "conv_id", "left").select(F.coalesce("key", root_name()).alias("key"), "conv_id"), "trie-ends")
    result = placed.join(below, "key").join(digests_of_members(ended), "key", "left")
    return result.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - F.col("upto") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK, **skew) -> DataFrame:
    """trie() of the conversations of a table (conv_id, turn, role, text) with shared heads; other columns are not read."""
    found = stored(turns(conversations, **skew), "trie-positions")
    sequences, ids = with_shared_heads(found, **skew)
    return trie(stored(sequences, "trie-sequences"), ids, block, **skew)
