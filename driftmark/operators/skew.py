"""Joins and ordered windows that keep working when one key holds a large share of all rows.

A key is *heavy* when it has more than ``1/parts`` of all rows; there are at most ``parts`` such
keys whatever the data, which is the bound behind every broadcast in this module.

Heavy keys are measured first, by one aggregate over the key columns, and kept in a checkpoint.
Without any, the plan is the plain one: one hash shuffle, nothing added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.session import cut_lineage

PARTS = 4000
MIN_ROWS = 1_000_000
STEP = 32
ROWS = 250_000  # of one task that sorts or groups whole rows by key


def heavy_keys(df: DataFrame, keys: Sequence[str], parts: int = PARTS, min_rows: int = MIN_ROWS) -> DataFrame:
    """`(keys, __n, __pieces)` of the keys with more than `1/parts` of the rows; at most `parts` rows.

    `__pieces` is how many parts' worth of rows a key has; over all heavy keys that is at most
    `2 * parts`.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    heavy = counts.filter((F.col("__n") > min_rows) & (F.col("__n") * parts > total))
    return heavy.withColumn("__pieces", F.ceil(F.col("__n") * parts / total).cast("int"))


def measured_keys(df: DataFrame, keys: Sequence[str], parts: int = PARTS, min_rows: int = MIN_ROWS) -> DataFrame:
    """The heavy keys as one small checkpoint; a shuffle brings them together, so that counting stays spread over the tasks."""
    return cut_lineage(heavy_keys(df, keys, parts, min_rows).repartition(1))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows of each key in one of as many partitions as `rows` need; few rows are left to the next shuffle.

    Adaptive execution joins shuffle partitions by their compressed bytes, which says little of the memory that sorting or
    grouping their rows takes; partitions dealt by number stay as they are.
    """
    return df if rows <= 4 * ROWS else df.repartition(-(-rows // ROWS), *keys)


def _mark(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Broadcast join to a bounded table of keys in which null is a key like any other."""
    renamed = small.select(*[F.col(k).alias(f"__on_{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__on_{i}"))
    return df.join(F.broadcast(renamed), same, how).drop(*[f"__on_{i}" for i in range(len(keys))])


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] = (),
    parts: int = PARTS,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Many-to-one equi-join (`dim` is unique per key) that spreads a heavy fact key over its `__pieces`.

    Only the dimension rows of heavy keys are repeated, once per piece: at most ``2 * parts`` rows.
    """
    measured = measured_keys(fact.select(*keys), keys, parts, min_rows)
    if measured.isEmpty():
        return fact.join(dim, list(keys), how)
    heavy = measured.select(*keys, "__pieces")
    spread = [F.col(c) for c in (salt_by or [c for c in fact.columns if c not in keys])]
    # A null key meets nothing, so its rows may go anywhere.
    unmatched = F.lit(False)
    for k in keys:
        unmatched = unmatched | F.col(k).isNull()
    salted_fact = _mark(fact, heavy, keys).withColumn(
        "__salt",
        F.when(
            F.col("__pieces").isNotNull() | unmatched, F.pmod(F.xxhash64(*spread), F.coalesce("__pieces", F.lit(STEP))).cast("int")
        ).otherwise(F.lit(0)),
    )
    salted_dim = _mark(dim, heavy, keys).withColumn(
        "__salt",
        F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)),
    )
    joined = salted_fact.drop("__pieces").join(salted_dim.drop("__pieces"), [*keys, "__salt"], how)
    return joined.drop("__salt")


class OrderedKeys:
    """Rows of each key in a total order, with heavy keys cut into ordered buckets.

    Split points of a heavy key are its rows whose order hash falls on every n-th value, so they
    are the same on every retry and there are about ``__pieces`` of them.  `order` has to be unique
    within a key.  `measure` may give cheaper rows to count keys on, at least as many per key.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        parts: int = PARTS,
        min_rows: int = MIN_ROWS,
        measure: DataFrame | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        narrow = df.select(*{*keys, *order})
        heavy = measured_keys(narrow if measure is None else measure, keys, parts, min_rows)
        self.split = not heavy.isEmpty()
        if not self.split:
            self.rows = dealt(df, keys, (narrow if measure is None else measure).count())
            self.window = Window.partitionBy(*keys).orderBy(*order)
            return
        rank = F.struct(*order)
        stride = F.ceil(F.col("__n") / F.col("__pieces"))
        points = (
            _mark(narrow, heavy, keys, "inner")
            .filter(F.pmod(F.xxhash64(*order), stride) == 0)
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_set(rank)).alias("__points"))
        )
        coarse = F.filter("__points", lambda p, i: i % STEP == 0).alias("__coarse")
        cuts = cut_lineage(
            _mark(heavy.select(*keys), points, keys).select(*keys, "__points", coarse, F.lit(True).alias("__heavy")).coalesce(1)
        )
        # Which bucket: first among every STEP-th point, then among the points up to the next of them.
        passed = F.size(F.filter("__coarse", lambda p: p < rank))
        start = (passed - 1) * STEP
        within = F.size(F.filter(F.slice("__points", start + 1, F.lit(STEP)), lambda p: p < rank))
        bucket = F.when(F.col("__points").isNull() | (passed == 0), 0).otherwise(start + within)
        self.rows = _mark(df, cuts, keys).withColumn("__bucket", bucket).drop("__points", "__coarse")
        self.window = Window.partitionBy(*keys, "__bucket").orderBy(*order)

    def _heavy_rows(self) -> DataFrame:
        return self.rows.filter(F.col("__heavy"))

    def _between_buckets(self):
        return Window.partitionBy(*self.keys).orderBy("__bucket")

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.drop("__bucket", "__heavy")

    def lag(self, columns: Sequence[str], into: str) -> DataFrame:
        """Adds struct `into` with the given columns of the preceding row (null for the first)."""
        held = F.struct(*columns)
        if not self.split:
            return self.rows.withColumn(into, F.lag(held).over(self.window))
        tails = self._heavy_rows().groupBy(*self.keys, "__bucket").agg(F.max_by(held, F.struct(*self.order)).alias("__tail"))
        carried = tails.select(
            *self.keys, "__bucket", F.lag("__tail").over(self._between_buckets()).alias("__carried")
        )
        local = self.rows.withColumn(into, F.lag(held).over(self.window))
        joined = _mark(local, carried, [*self.keys, "__bucket"])
        return self._clean(joined.withColumn(into, F.coalesce(into, "__carried")).drop("__carried"))

    def running_sums(self, amounts: dict[str, Column]) -> DataFrame:
        """Adds inclusive running totals, one column per entry of `amounts`."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            return self.rows.select("*", *[F.sum(a).over(frame).alias(n) for n, a in amounts.items()])
        totals = self._heavy_rows().groupBy(*self.keys, "__bucket").agg(
            *[F.sum(a).alias(f"__s_{n}") for n, a in amounts.items()]
        )
        earlier = self._between_buckets().rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *self.keys, "__bucket", *[F.sum(f"__s_{n}").over(earlier).alias(f"__o_{n}") for n in amounts]
        )
        local = self.rows.select("*", *[F.sum(a).over(frame).alias(n) for n, a in amounts.items()])
        joined = _mark(local, offsets, [*self.keys, "__bucket"])
        for name in amounts:
            joined = joined.withColumn(name, F.col(name) + F.coalesce(f"__o_{name}", F.lit(0)))
        return self._clean(joined.drop(*[f"__o_{n}" for n in amounts]))

    def positions(self, into: str) -> DataFrame:
        """Adds the 1-based position within the key."""
        return self.running_sums({into: F.lit(1).cast("bigint")})


def expand_copies(df: DataFrame, copies: str, into: str, chunk: int = 4096) -> DataFrame:
    """One row per copy with its number 1..n; large counts are cut and spread before they expand."""
    last = F.floor((F.col(copies) - 1) / chunk)
    chunks = df.filter(F.col(copies) > 0).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spread = chunks.repartition(F.xxhash64(*[c for c in df.columns], "__chunk"))
    start = F.col("__chunk") * chunk + 1
    return spread.withColumn(
        into, F.explode(F.sequence(start, F.least(start + chunk - 1, F.col(copies).cast("bigint"))))
    ).drop("__chunk")
