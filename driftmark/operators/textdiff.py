"""Word and line diffs of text pairs.

The alignment itself is the one thing Catalyst cannot express; it runs in Arrow batches over the
changed pairs only.  Everything derived from the tokens is native.
"""

from __future__ import annotations

import difflib
import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from driftmark import presets
from driftmark.functions import text as X

TOKENS = ArrayType(StructType().add("op", StringType()).add("text", StringType()))
CLOSE = 0.75  # similarity from which two words count as one word that was edited
HELD = 1 << 15  # tokens, runs or lines of whole pairs that wait in a Python worker before they are handed on


def _close_words(old: list[str], new: list[str]) -> list[list[tuple[str, str]]]:
    """Pairs of different but similar words, grouped by similarity, most similar first."""
    groups: dict[float, list[tuple[str, str]]] = defaultdict(list)
    matcher = difflib.SequenceMatcher(difflib.IS_CHARACTER_JUNK)
    lengths = sorted(set(old), key=len)
    sizes = [len(w) for w in lengths]
    for word in dict.fromkeys(new):
        matcher.set_seq2(word)
        # 2 * min / (sum of lengths) bounds the similarity from above.
        low = bisect_left(sizes, math.ceil(len(word) * CLOSE / (2 - CLOSE)))
        high = bisect_right(sizes, math.floor(len(word) * (2 - CLOSE) / CLOSE))
        for other in lengths[low:high]:
            if other != word:
                matcher.set_seq1(other)
                if matcher.quick_ratio() >= CLOSE and matcher.ratio() >= CLOSE:
                    groups[matcher.ratio()].append((other, word))
    return [groups[r] for r in sorted(groups, reverse=True)]


def _first(places: list[int], low: int, high: int) -> int | None:
    at = bisect_left(places, low)
    return places[at] if at < len(places) and places[at] < high else None


def _replaced(old: list[str], new: list[str]):
    """Tokens of a replaced block: similar words are set against each other, the most similar first.

    Same result as the `ndiff` search over all pairs of places, but similarities are computed once
    per pair of distinct words and blocks are split from a stack, so long rewrites neither recurse
    nor compare the same words again.
    """
    at_old, at_new = defaultdict(list), defaultdict(list)
    for i, w in enumerate(old):
        at_old[w].append(i)
    for j, w in enumerate(new):
        at_new[w].append(j)
    stack = [(0, len(old), 0, len(new), _close_words(old, new))]
    while stack:
        block = stack.pop()
        if len(block) == 2:
            yield block
            continue
        alo, ahi, blo, bhi, close = block
        if alo == ahi or blo == bhi:
            yield from (("delete", w) for w in old[alo:ahi])
            yield from (("insert", w) for w in new[blo:bhi])
            continue
        best, left = None, []
        for group in close:
            here = []
            for pair in group:
                i, j = _first(at_old[pair[0]], alo, ahi), _first(at_new[pair[1]], blo, bhi)
                if i is not None and j is not None:
                    here.append((j, i, pair))
            if here:
                best = best or min(here)[:2]
                left.append([p for _, _, p in here])
        if best:
            j, i = best
            middle = [("insert", new[j]), ("delete", old[i])]
        else:
            equal = ((j, _first(at_old.get(new[j], []), alo, ahi)) for j in range(blo, bhi))
            j, i = next(((j, i) for j, i in equal if i is not None), (None, None))
            if j is None:
                sides = [[("delete", w) for w in old[alo:ahi]], [("insert", w) for w in new[blo:bhi]]]
                yield from (t for side in (reversed(sides) if bhi - blo < ahi - alo else sides) for t in side)
                continue
            middle = [("equal", old[i])]
        stack.append((i + 1, ahi, j + 1, bhi, left))
        stack.extend(middle)
        stack.append((alo, i, blo, j, left))


def word_tokens(before: str, after: str) -> list[tuple[str, str]]:
    """`ndiff` tokens of two texts by words, without its hint lines."""
    old, new = before.split(), after.split()
    tokens = []
    for op, i, k, j, n in difflib.SequenceMatcher(None, old, new).get_opcodes():
        if op == "replace":
            tokens.extend(_replaced(old[i:k], new[j:n]))
        else:
            tokens.extend((op, w) for w in (new[j:n] if op == "insert" else old[i:k]))
    return tokens


def _lists(batches: Iterator[tuple[pa.Array, pa.Array]], diff: Callable[[str, str], list], values: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """A list per pair, null where a side is null.

    A batch counts rows, and a row may hold long texts: lists are given out as soon as HELD items wait, so that
    a worker holds those, and one pair's.
    """
    for before, after in batches:
        items, ends, missing = [], [0], []
        for b, a in zip(before, after):
            b, a = b.as_py(), a.as_py()
            missing.append(b is None or a is None)
            if not missing[-1]:
                items.extend(diff(b, a))
            ends.append(len(items))
            if len(items) >= HELD:
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values(items), mask=pa.array(missing))
                items, ends, missing = [], [0], []
        if missing:
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values(items), mask=pa.array(missing))


def _texts(items: list[str]) -> pa.Array:
    return pa.array(items, pa.string())


def _structs(names: Sequence[str]) -> Callable[[list[tuple]], pa.Array]:
    return lambda items: pa.StructArray.from_arrays([_texts([x[i] for x in items]) for i in range(len(names))], names)


@F.arrow_udf(TOKENS)
def word_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Word diff of the whole texts (before, after); null where a side is null."""
    return _lists(batches, word_tokens, _structs(["op", "text"]))


RUNS = ArrayType(StructType().add("op", StringType()).add("removed", StringType()).add("added", StringType()))


@F.arrow_udf(RUNS)
def word_runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Changed runs of words (before, after) without the popularity heuristic: op, removed words, added words."""

    def runs(b, a):
        old, new = b.split(), a.split()
        blocks = difflib.SequenceMatcher(a=old, b=new, autojunk=False).get_opcodes()
        return [(op, " ".join(old[i:j]), " ".join(new[k:n])) for op, i, j, k, n in blocks if op != "equal"]

    return _lists(batches, runs, _structs(["op", "removed", "added"]))


@F.arrow_udf(ArrayType(StringType()))
def unified_lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Unified diff of the lines of two texts (before, after)."""

    def lines(b, a):
        old, new = b.splitlines() or [b], a.splitlines() or [a]
        return list(difflib.unified_diff(old, new, "before", "after", lineterm=""))

    return _lists(batches, lines, _texts)


def spread_pairs(df: DataFrame, *by: str) -> DataFrame:
    """Deal changed pairs evenly over the tasks, so one file or key with the long texts is no straggler."""
    return df.repartition(F.xxhash64(*by))


# ---- everything below is native -----------------------------------------------------------------


def line_diff(before: Column, after: Column, lines: Column, tokens: Column, min_chars: int = 120) -> Column:
    """Line diff, followed by the changed words when one side has at least `min_chars` characters."""
    sign = F.create_map(F.lit("delete"), F.lit("- "), F.lit("insert"), F.lit("+ "))
    changed = F.transform(
        F.filter(tokens, lambda t: t["op"] != "equal"), lambda t: F.concat(F.element_at(sign, t["op"]), t["text"])
    )
    long = F.greatest(F.length(before), F.length(after)) >= min_chars
    heading = F.array(F.lit(""), F.lit("Word-level text changes:"))
    return F.when(long & (F.size(changed) > 0), F.concat(lines, heading, changed)).otherwise(lines)


def tokens_of(tokens: Column, op: str) -> Column:
    return F.filter(tokens, lambda t: t["op"] == op)


def joined(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")


def group_count(tokens: Column, op: str) -> Column:
    """Number of uninterrupted runs of one op."""
    starts = F.filter(
        F.transform(
            tokens,
            lambda t, i: (t["op"] == op)
            & ((i == 0) | (F.coalesce(F.try_element_at(tokens, F.greatest(i, F.lit(1)))["op"], F.lit("")) != op)),
        ),
        lambda s: s,
    )
    return F.size(starts)


def text_change_kind(tokens: Column) -> Column:
    """removed / added / replaced / modified / mixed, from the op pattern."""
    deleted, inserted = tokens_of(tokens, "delete"), tokens_of(tokens, "insert")
    has_deleted, has_inserted = F.size(deleted) > 0, F.size(inserted) > 0
    single = (group_count(tokens, "delete") == 1) & (group_count(tokens, "insert") == 1)

    def plain(part: Column) -> Column:
        return F.translate(F.lower(F.trim(joined(part))), ".,;:", "")

    def sentence(part: Column) -> Column:
        return (X.word_count(joined(part)) >= 4) & F.trim(joined(part)).rlike(r"[.!?]$")

    old, new = plain(deleted), plain(inserted)
    both_named = (old != "") & (new != "")
    return (
        F.when(has_deleted & ~has_inserted, F.lit("text_removed"))
        .when(has_inserted & ~has_deleted, F.lit("text_added"))
        .when(~has_deleted, F.lit("text_modified"))
        .when(~single, F.lit("mixed_text_change"))
        .when(both_named & F.contains(new, old), F.lit("text_added"))
        .when(both_named & F.contains(old, new), F.lit("text_removed"))
        .when(sentence(deleted) & sentence(inserted), F.lit("text_replaced"))
        .otherwise(F.lit("text_modified"))
    )


def changed_words(tokens: Column, op: str) -> Column:
    return F.aggregate(tokens_of(tokens, op), F.lit(0), lambda n, t: n + X.word_count(t["text"]))


def long_text_summary(tokens: Column, kind: Column) -> Column:
    removed, added = changed_words(tokens, "delete"), changed_words(tokens, "insert")
    table = F.create_map(*[F.lit(x) for pair in presets.TEXT_KIND_LABELS.items() for x in pair])
    return (
        F.when((removed > 0) & (added == 0), F.format_string(presets.LONG_TEXT_REMOVED, removed))
        .when((added > 0) & (removed == 0), F.format_string(presets.LONG_TEXT_ADDED, added))
        .when((removed > 0) | (added > 0), F.format_string(presets.LONG_TEXT_BOTH, removed, added))
        .otherwise(F.coalesce(F.try_element_at(table, kind), F.lit(presets.LONG_TEXT_DEFAULT)))
    )


def is_long_text(before: Column, after: Column, chars: int = 400, word_limit: int = 60) -> Column:
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    return (
        (F.length(b) > chars)
        | (F.length(a) > chars)
        | (X.word_count(b) > word_limit)
        | (X.word_count(a) > word_limit)
    )


def first_changed_phrase(tokens: Column, op: str, limit: int = 240) -> Column:
    """Words of the first run of an op."""
    zero = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("words"))

    def step(acc, t):
        hit = t["op"] == op
        return (
            F.when((acc["state"] < 2) & hit, F.struct(F.lit(1).alias("state"), F.array_append(acc["words"], t["text"]).alias("words")))
            .when((acc["state"] == 1) & ~hit, F.struct(F.lit(2).alias("state"), acc["words"].alias("words")))
            .otherwise(acc)
        )

    found = F.aggregate(tokens, zero, step)["words"]
    phrase = F.trim(F.array_join(F.filter(found, lambda w: w != ""), " "))
    cut = F.concat(F.rtrim(F.substring(phrase, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(phrase) <= limit, phrase).otherwise(cut)


def changed_text(tokens: Column, op: str, limit: int = 500) -> Column:
    """All words of an op, cut to `limit` characters plus `...`."""
    text = X.clean_text(joined(tokens_of(tokens, op)))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("...")))


def phrase_signature(tokens: Column) -> Column:
    """Lower-case changed words, the identity of a text change; null when nothing changed."""
    changed = F.filter(
        F.transform(F.filter(tokens, lambda t: t["op"].isin("insert", "delete")), lambda t: F.lower(F.trim(t["text"]))),
        lambda w: w != "",
    )
    return F.when(F.size(changed) > 0, F.array_join(changed, " "))


def removed_runs(runs: Column) -> Column:
    return F.transform(F.filter(runs, lambda r: r["op"].isin("delete", "replace")), lambda r: r["removed"])


def diff_excerpt(runs: Column, part_limit: int = 180, limit: int = 500) -> Column:
    """Removed and added runs, each cut, joined by ` | ` until `limit` characters are reached."""
    parts = F.flatten(
        F.transform(
            runs,
            lambda r: F.array(
                F.struct(
                    F.when(r["removed"] != "", F.concat(F.lit(presets.EXCERPT_REMOVED), X.compact(r["removed"], part_limit))).alias("text"),
                    F.lit(False).alias("last"),
                ),
                F.struct(
                    F.when(r["added"] != "", F.concat(F.lit(presets.EXCERPT_ADDED), X.compact(r["added"], part_limit))).alias("text"),
                    F.lit(True).alias("last"),
                ),
            ),
        )
    )
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(acc, p):
        grown = F.when(p["text"].isNull(), acc["text"]).when(acc["text"] == "", p["text"]).otherwise(
            F.concat_ws(" | ", acc["text"], p["text"])
        )
        return F.when(acc["full"], acc).otherwise(
            F.struct(grown.alias("text"), (p["last"] & (F.length(grown) >= limit)).alias("full"))
        )

    text = F.aggregate(parts, zero, step)["text"]
    return F.when(text == "", F.lit(presets.EXCERPT_DEFAULT)).otherwise(X.compact(text, limit))


def excerpt_windows(tokens: Column, context: int = 22, budget: int = 150) -> Column:
    """Token windows around the changes: array of struct(start, stop), stop exclusive.

    Windows that touch are merged; windows are kept from the left while they fit the budget, the
    first one always.
    """
    count = F.size(tokens)
    changed = F.filter(
        F.transform(tokens, lambda t, i: F.when(t["op"] != "equal", i)), lambda i: i.isNotNull()
    )
    spans = F.transform(
        changed,
        lambda i: F.struct(F.greatest(F.lit(0), i - context).alias("start"), F.least(count, i + context + 1).alias("stop")),
    )
    kind = "array<struct<start:int,stop:int>>"

    def merge(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        widened = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["stop"]), F.array_append(head, widened)).otherwise(
            F.array_append(acc, s)
        )

    merged = F.aggregate(spans, F.array().cast(kind), merge)
    zero = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def keep(acc, w):
        size = w["stop"] - w["start"]
        over = (F.size(acc["kept"]) > 0) & (acc["used"] + size > budget)
        return (
            F.when(acc["full"], acc)
            .when(over, F.struct(acc["kept"].alias("kept"), acc["used"].alias("used"), F.lit(True).alias("full")))
            .otherwise(
                F.struct(
                    F.array_append(acc["kept"], w).alias("kept"), (acc["used"] + size).alias("used"), F.lit(False).alias("full")
                )
            )
        )

    return F.aggregate(merged, zero, keep)["kept"]


def excerpt_side(tokens: Column, windows: Column, side: str) -> Column:
    """The tokens one side shows: ellipses between windows and where the text goes on."""
    own = "delete" if side == "before" else "insert"
    dots = F.array(F.struct(F.lit("ellipsis").alias("op"), F.lit("...").alias("text")))
    nothing = F.slice(dots, F.lit(1), F.lit(0))
    shown = F.flatten(
        F.transform(
            windows,
            lambda w, i: F.concat(
                F.when((i > 0) | (w["start"] > 0), dots).otherwise(nothing),
                F.filter(F.slice(tokens, w["start"] + 1, w["stop"] - w["start"]), lambda t: t["op"].isin("equal", own)),
            ),
        )
    )
    more = F.element_at(windows, -1)["stop"] < F.size(tokens)
    return F.when(F.size(windows) == 0, tokens).otherwise(F.concat(shown, F.when(more, dots).otherwise(nothing)))


def excerpt_truncated(tokens: Column, windows: Column) -> Column:
    count = F.size(windows)
    cut = (F.try_element_at(windows, F.lit(1))["start"] > 0) | (F.try_element_at(windows, F.lit(-1))["stop"] < F.size(tokens))
    return F.coalesce((count > 1) | cut, F.lit(False))


def bag_statistics(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Words removed and added per entity as bags, without any alignment.

    Counts per `(entity, word)` are combined before the shuffle, so neither a long text nor a
    frequent word gathers in one task.
    """
    sides = F.array(
        F.struct(X.words(F.col(before)).alias("w"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(X.words(F.col(after)).alias("w"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )
    counted = (
        pairs.select(key, F.explode(sides).alias("s"))
        .select(key, F.explode("s.w").alias("word"), "s.b", "s.a")
        .groupBy(key, "word")
        .agg((F.sum("b") - F.sum("a")).alias("d"))
        .filter("d <> 0")
    )
    return counted.groupBy(key).agg(
        F.sum(F.greatest("d", F.lit(0))).alias("words_removed"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("words_added"),
    )
