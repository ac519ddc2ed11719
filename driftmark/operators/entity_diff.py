"""Two versions of a keyed table: added, removed and changed entities, and field-level changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.presets import DEFAULT, Profile

ADDED, REMOVED, CHANGED, UNCHANGED = "added", "removed", "changed", "unchanged"


def fingerprint(columns: Sequence[str]) -> Column:
    """96 hash bits over the columns; equal rows have equal fingerprints.

    The hashes skip nulls, so they are taken of a text that names each column with its value; a value that
    moves from one column to another changes it.  Two independent hashes are compared, so the chance
    that a changed entity is taken for an unchanged one is 2^-96.
    """
    values = [F.to_json(F.struct(*columns))]
    return F.struct(F.xxhash64(*values).alias("h64"), F.hash(*values).alias("h32"))


def classify_entities(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str] = ()) -> DataFrame:
    """`(key, kind)` for every entity of either version.

    Only the key and the fingerprint are shuffled, whatever the row width.  A stored column
    `fingerprint` is used when both sides have it.  Both sides hold one row per key.
    """

    def narrow(df: DataFrame, name: str) -> DataFrame:
        stored = "fingerprint" in before.columns and "fingerprint" in after.columns
        mark = F.col("fingerprint") if stored else fingerprint(columns or [c for c in df.columns if c != key])
        return df.select(key, mark.alias(name))

    pairs = narrow(before, "__b").join(narrow(after, "__a"), key, "full_outer")
    kind = (
        F.when(F.col("__b").isNull(), ADDED)
        .when(F.col("__a").isNull(), REMOVED)
        .when(F.col("__b") == F.col("__a"), UNCHANGED)
        .otherwise(CHANGED)
    )
    return pairs.select(key, kind.alias("kind"))


def pair_entities(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """`(key, before struct, after struct)` for every entity; the missing side is null.

    One shuffle per side, none when both are bucketed by the key.
    """
    old = before.select(key, F.struct(*columns).alias("before"))
    new = after.select(key, F.struct(*columns).alias("after"))
    return old.join(new, key, "full_outer")


def changed_pairs(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], changed: DataFrame | None = None) -> DataFrame:
    """Pairs of the changed entities only: a narrow join finds the keys, a second one fetches the rows.

    Pass `changed` (the keys, already written) to have its size known before the rows are fetched.
    """
    if changed is None:
        changed = classify_entities(before, after, key, columns).filter(F.col("kind") == CHANGED).select(key)
    old = before.join(changed, key, "left_semi").select(key, F.struct(*columns).alias("before"))
    new = after.join(changed, key, "left_semi").select(key, F.struct(*columns).alias("after"))
    return old.join(new, key)


def field_changes(pairs: DataFrame, key: str, fields: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """`(key, field, before, after)` per differing column of pairs whose columns are known and flat."""
    compared = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"before.{f}").cast("string").alias("before"),
                F.col(f"after.{f}").cast("string").alias("after"),
            )
            for f in fields
            if f not in ignored
        ]
    )
    common = pairs.filter(F.col("before").isNotNull() & F.col("after").isNotNull())
    different = F.filter(compared, lambda c: ~c["before"].eqNullSafe(c["after"]))
    return common.select(key, F.explode(different).alias("c")).select(key, "c.*")


def ignored_path(path: Column, profile: Profile = DEFAULT) -> Column:
    """Paths the diff skips: exact names, and prefixes with everything below them."""
    hit = path.isin(*profile.ignored_paths)
    for prefix in profile.ignored_prefixes:
        hit = hit | (path == prefix) | F.startswith(path, F.lit(prefix + "."))
    return hit


def document_changes(
    df: DataFrame, before: str = "before", after: str = "after", profile: Profile = DEFAULT, max_depth: int | None = None
) -> DataFrame:
    """Recursive field changes of two VARIANT columns: all other columns, `path`, `field`, `before`, `after`.

    Objects are compared member by member; a member on one side only is one change with its whole
    subtree; lists and everything else are compared as a whole.  The descent is a chain of
    generators over the row itself, so it shuffles nothing and ends early where subtrees are equal.
    There are as many levels as the documents have, measured first by one aggregate; with a `max_depth` of
    the caller's, differing objects below it stop the job.
    """
    if max_depth is None:
        max_depth = V.measured_depth(df, before, after)
    keep = [c for c in df.columns if c not in (before, after)]
    differs = V.canonical(F.col(before)) != V.canonical(F.col(after))
    rows = df.filter(differs).select(
        *keep,
        F.array().cast("array<string>").alias("path"),
        F.col(before).alias("before"),
        F.col(after).alias("after"),
        F.lit(True).alias("__open"),
    )
    for _ in range(max_depth):
        # The members of both sides are columns of their own, so they are read once per row.
        opened = rows.withColumns(
            {f"__{side}": F.when(F.col("__open"), V.as_object(F.col(side))) for side in ("before", "after")}
        )
        members = F.transform(
            F.array_sort(F.array_union(F.map_keys("__before"), F.map_keys("__after"))),
            lambda k: F.struct(
                F.concat("path", F.array(k)).alias("path"),
                F.try_element_at("__before", k).alias("before"),
                F.try_element_at("__after", k).alias("after"),
                (F.map_contains_key("__before", k) & F.map_contains_key("__after", k)).alias("__open"),
            ),
        )
        relevant = F.filter(
            members,
            lambda m: ~ignored_path(F.array_join(m["path"], "."), profile)
            & (~m["__open"] | (V.canonical(m["before"]) != V.canonical(m["after"]))),
        )
        itself = F.array(F.struct("path", "before", "after", F.lit(False).alias("__open")))
        both = F.col("__before").isNotNull() & F.col("__after").isNotNull()
        rows = opened.select(*keep, F.explode(F.when(both, relevant).otherwise(itself)).alias("__m")).select(*keep, "__m.*")
    deeper = F.col("__open") & V.as_object(F.col("before")).isNotNull() & V.as_object(F.col("after")).isNotNull()
    guard = F.when(deeper, F.raise_error(F.lit("objects differ below document_changes(max_depth)")).cast("boolean")).otherwise(F.lit(True))
    field = F.when(F.size("path") == 0, F.lit("<root>")).otherwise(F.array_join("path", "."))
    return rows.filter(guard).select(*keep, "path", field.alias("field"), "before", "after")


def diff_summary(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"))


def changed_field_counts(changes: DataFrame, key: str) -> DataFrame:
    """Per entity how many fields changed (the fields themselves are the rows of `changes`)."""
    return changes.groupBy(key).agg(F.count(F.lit(1)).alias("changed_fields"))


def key_sets(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The four key sets as rows `(set_name, key)` from one join of the keys."""
    marks = (
        before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a"))
        .unionByName(after.select(key, F.lit(0).alias("b"), F.lit(1).alias("a")))
        .groupBy(key)
        .agg(F.max("b").alias("b"), F.max("a").alias("a"))
    )
    names = F.array_compact(
        F.array(
            F.when(F.col("b") == 0, F.lit("only_after")),
            F.when(F.col("a") == 0, F.lit("only_before")),
            F.when((F.col("a") == 1) & (F.col("b") == 1), F.lit("in_both")),
            F.lit("in_either"),
        )
    )
    return marks.select(F.explode(names).alias("set_name"), key)
