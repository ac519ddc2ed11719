"""Field changes between flat node tables: one row per node of every document, compared by joins of paths.

The same changes as `entity_diff.document_changes`, for documents too large to be compared inside a row, and of any
depth: no plan has a level of its own for every level of a document.  A hot entity is no hot key, since the
path is part of every join key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import skew
from driftmark.operators.entity_diff import ignored_path
from driftmark.presets import DEFAULT, Profile
from driftmark.session import cut_lineage

LEVELS = 8
PATH = "array<string>"
SIDES = ("before", "after")


def node_table(docs: DataFrame, keys: Sequence[str], doc: str = "doc", levels: int = LEVELS) -> DataFrame:
    """`(keys, path, is_object, h64, h32, value)`: a row per object member and per document (empty path).

    Lists are leaves, as they are compared whole.  `h64` and `h32` are hashes of the whole subtree; `value` is the canonical
    text of a leaf, an empty object among them, and null for other objects.  A document that is null counts as JSON null;
    no documents give no rows.  `keys` are unique in `docs`; other columns are left out.

    Documents are opened `levels` levels at a time.  What is still open then goes into another round, until
    nothing is: plans have one size whatever the depth, and rounds get only the rows that need them.
    """
    pending = docs.select(*keys, F.array().cast(PATH).alias("path"), F.col(doc).alias("__node"))
    rounds = []
    while True:
        opened = cut_lineage(_opened(pending, keys, levels))
        rounds.append(opened.filter(~F.col("__open")).drop("__open", "__node"))
        pending = opened.filter("__open").select(*keys, "path", "__node")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def _opened(pending: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """The nodes down to `levels` levels; objects at the last of them are `__open`, and keep their `__node`."""
    rows = pending.withColumn("__open", F.lit(True))
    for _ in range(levels):
        members = F.transform(
            F.map_entries(V.as_object(F.col("__node"))),
            lambda e: F.struct(F.concat("path", F.array(e["key"])).alias("path"), e["value"].alias("__node"), F.lit(True).alias("__open")),
        )
        itself = F.array(F.struct("path", "__node", F.lit(False).alias("__open")))
        step = F.when(F.col("__open"), F.concat(itself, F.coalesce(members, F.slice(itself, 1, 0)))).otherwise(itself)
        rows = rows.select(*keys, F.explode(step).alias("__n")).select(*keys, "__n.*")
    members = V.as_object(F.col("__node"))
    is_open = F.col("__open") & members.isNotNull()
    # Of a node that is opened later, nothing but the node is worked out here.
    described = rows.withColumns(
        {
            "__open": is_open,
            "is_object": members.isNotNull(),
            "__leaf": members.isNull() | (F.size(members) == 0),
            "__text": F.when(~is_open, V.canonical(F.col("__node"))),
        }
    )
    return described.select(
        *keys,
        "path",
        "is_object",
        F.xxhash64("__text").alias("h64"),
        F.hash("__text").alias("h32"),
        F.when(F.col("__leaf"), F.col("__text")).alias("value"),
        "__open",
        F.when(F.col("__open"), F.col("__node")).alias("__node"),
    )


def _ignored(path: Column, profile: Profile) -> Column:
    """The path or one that it lies below is ignored."""
    sizes = F.filter(F.sequence(F.lit(0), F.size(path)), lambda n: n > 0)
    return F.exists(sizes, lambda n: ignored_path(F.array_join(F.slice(path, 1, n), "."), profile))


class NodeDiff:
    """The changes between two node tables.

    Two joins find them, of paths and hashes only: a full outer join of the nodes, and a lookup that tells whether the other
    side of a node without a partner has an object there that could have held it.  Entities of one side only, and rows with
    a null key, give no changes.  Pass tables without the entities whose fingerprints are equal where that is known.
    """

    def __init__(self, before: DataFrame, after: DataFrame, keys: Sequence[str], profile: Profile = DEFAULT):
        self.keys = list(keys)
        self.tables = dict(zip(SIDES, (before, after)))
        narrow = [
            df.select(*keys, "path", F.struct("is_object", "h64", "h32", F.col("value").isNotNull().alias("is_leaf")).alias(side))
            for side, df in self.tables.items()
        ]
        pairs = narrow[0].join(narrow[1], [*keys, "path"], "full_outer")
        absent = F.when(F.col("before").isNull(), "before").when(F.col("after").isNull(), "after")
        both_objects = F.col("before.is_object") & F.col("after.is_object")
        differ = (F.col("before.h64") != F.col("after.h64")) | (F.col("before.h32") != F.col("after.h32"))
        found = pairs.filter(absent.isNotNull() | (~both_objects & differ)).filter(~_ignored_below_pairs(profile))
        self.differing = cut_lineage(
            found.select(
                *keys,
                "path",
                F.coalesce("before.is_leaf", F.lit(False)).alias("before"),
                F.coalesce("after.is_leaf", F.lit(False)).alias("after"),
                absent.alias("absent"),
                F.when(F.size("path") > 0, F.slice("path", 1, F.size("path") - 1)).alias("parent"),
            )
        )
        self.profile = profile

    def changes(self) -> DataFrame:
        """`(keys, path, field, absent)`: what differs, uppermost nodes only; `absent` names the side without the node."""
        objects = [
            df.filter("is_object").select(*self.keys, F.col("path").alias("parent"), F.lit(side).alias("absent"), F.lit(True).alias("__held"))
            for side, df in self.tables.items()
        ]
        looked_up = skew.lookup_join(
            self.differing, objects[0].unionByName(objects[1]), [*self.keys, "parent", "absent"], salt_by=["path"]
        )
        uppermost = looked_up.filter(F.col("absent").isNull() | F.col("__held")).filter(~_ignored(F.col("path"), self.profile))
        field = F.when(F.size("path") == 0, F.lit("<root>")).otherwise(F.array_join("path", "."))
        return uppermost.select(*self.keys, "path", field.alias("field"), "absent")

    def leaves(self) -> DataFrame:
        """`(keys, path, field, side, leaf, value)`: a row per leaf at or below a change; nothing is gathered.

        Only leaves that differ look for the change they belong to, and only they fetch their values.
        """
        leaf = self.differing.select(
            *self.keys,
            F.col("path").alias("leaf"),
            F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in SIDES]))).alias("side"),
        )
        above = leaf.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size("leaf")), lambda n: F.slice("leaf", 1, n))).alias("path"))
        placed = skew.lookup_join(above, self.changes().select(*self.keys, "path", "field"), [*self.keys, "path"], "inner", ["leaf", "side"])
        values = [
            df.filter(F.col("value").isNotNull()).select(*self.keys, F.col("path").alias("leaf"), F.lit(s).alias("side"), "value")
            for s, df in self.tables.items()
        ]
        fetched = placed.join(values[0].unionByName(values[1]), [*self.keys, "leaf", "side"])
        return fetched.select(*self.keys, "path", "field", "side", "leaf", "value")

    def texts(self) -> DataFrame:
        """`(keys, path, field, before, after)` with canonical texts, null on an absent side.

        The leaves of one change meet in one row here, as the text is one value; `leaves` is the form for changes too
        large for that.  Members stand in the order of their keys' UTF-8 bytes.
        """
        below = F.slice("leaf", F.size("path") + 1, F.size("leaf"))
        part = F.struct(below.alias("path"), F.col("value").alias("text"))
        sides = [F.array_sort(F.collect_list(F.when(F.col("side") == s, part))).alias(f"__{s}") for s in SIDES]
        gathered = self.leaves().groupBy(*self.keys, "path", "field").agg(*sides)
        return gathered.select(*self.keys, "path", "field", *[_text_of(F.col(f"__{s}")).alias(s) for s in SIDES])


def _ignored_below_pairs(profile: Profile) -> Column:
    """A differing pair at an ignored path.  Nodes of one side stay: they may be part of a change above the ignored path."""
    return F.col("before").isNotNull() & F.col("after").isNotNull() & _ignored(F.col("path"), profile)


def _text_of(leaves: Column) -> Column:
    """JSON text of sorted `(path, text)` leaves: each closes what the one before it left open, and opens its own objects."""

    def names(path: Column) -> Column:
        quoted = lambda k: V.let(F.to_json(F.array(k)), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))
        return F.array_join(F.transform(path, lambda k: F.concat(quoted(k), F.lit(":"))), "{")

    def piece(leaf: Column, i: Column) -> Column:
        path, last = leaf["path"], F.get(leaves, i - 1)["path"]
        shared = F.array_position(F.zip_with(path, last, lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
        first = F.concat(F.when(F.size(path) > 0, "{").otherwise(""), names(path))
        later = F.concat(F.repeat(F.lit("}"), F.size(last) - 1 - shared), F.lit(","), names(F.slice(path, shared + 1, F.size(path))))
        return F.concat(F.when(i == 0, first).otherwise(later), leaf["text"])

    closed = F.repeat(F.lit("}"), F.size(F.element_at(leaves, -1)["path"]))
    return F.when(F.size(leaves) > 0, F.concat(F.array_join(F.transform(leaves, piece), ""), closed))
