"""Removal of repeated lines across documents by a deletion-neighbourhood join, in DataFrame functions only.

Lines are sequences of words between ASCII white space. Two lines are near if one word inserted, left out or
replaced turns one into the other (an edit distance of one, in words) and both have at least five words. A line
goes if an equal or near line stands earlier, in order of doc_id and line number.

Equal lines are found by 128 bits. A near line's variants are the line without one of its words; a pair of near
lines shares either a variant at the same place (a replaced word), or a variant of one is the whole other line. So
each group of equal variants needs only its earliest line, never its pairs: a replacement group's members are
all near to the earliest one, and at most one line is the whole of a variant. A variant's key is the exclusive-or
of one hash per word and place, so all variants of a line take one pass over it, however long it is.

Before variants are made, lines are told from those that can't have a near line: of two near lines, the first or the
second half is the same, so a line none of whose half keys occurs in another line is left out, and nothing is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.work import stored

#: A run of ASCII white space that is not one space already.
SPACES = r"\x20{2,}[\x20\x09-\x0D]*|\x20?[\x09-\x0D][\x20\x09-\x0D]*"
LEAST_WORDS = 5
BLOCK = 32  # words whose keys are combined first


def _collapsed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACES, " "))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _half_keys(words: Column, n: Column) -> Column:
    """Keys of the halves that a near line of as many words, one more or one fewer has as well."""
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def key(side: int, start: Column, size: Column) -> Column:
        return F.xxhash64(F.lit(side), size, F.slice(words, start, size))

    first = [key(0, F.lit(1), size) for size in (half, less)]
    second = [key(1, n - size + 1, size) for size in (n - half, n - 1 - less)]
    return F.array_distinct(F.array(*first, *second))


def line_keys(docs: DataFrame) -> DataFrame:
    """at (doc_id, line_no, row), two hashes of the line, and its half keys; without blank lines."""
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select(F.struct("doc_id", "line_no", "row").alias("at"), _collapsed(F.col("line")).alias("line")).filter("line != ''")
    words = lines.select("at", "line", F.split("line", " ").alias("words")).withColumn("n", F.size("words"))
    return words.select(
        "at",
        F.xxhash64(F.lit(1), "line").alias("h1"),
        F.xxhash64(F.lit(2), "line").alias("h2"),
        F.when(F.col("n") >= LEAST_WORDS, _half_keys(F.col("words"), F.col("n"))).alias("halves"),
    )


def _variants(lines: DataFrame) -> DataFrame:
    """(a, b, pos, at, n) of each line (at, words): pos 0 is the whole line, pos i the line without its i-th word."""

    def hashed(seed: int, shift: int):
        return lambda w, i: F.xxhash64(F.lit(seed), w, i - shift)

    def block_of(column: str):
        return lambda j: _fold(F.slice(column, j * BLOCK + 1, F.lit(BLOCK)))

    def first_of(column: str):
        return lambda j: _fold(F.slice(column, F.lit(1), j))

    n = F.size("words")
    keyed = lines.select("at", "words", n.alias("n"))
    for k, seed in (("a", 11), ("b", 12)):
        here, moved, changed, sums = (f"{k}_{c}" for c in ("here", "moved", "changed", "sums"))
        keyed = keyed.withColumn(here, F.transform("words", hashed(seed, 0))).withColumn(moved, F.transform("words", hashed(seed, 1)))
        keyed = keyed.withColumn(changed, F.zip_with(here, moved, lambda x, y: x.bitwiseXOR(y)))
        keyed = keyed.withColumn(sums, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block_of(changed)))
        keyed = keyed.withColumn(sums, F.transform(F.sequence(F.lit(0), F.size(sums) - 1), first_of(sums)))
        keyed = keyed.withColumn(f"{k}_rest", _fold(F.col(moved))).withColumn(f"{k}_whole", _fold(F.col(here)))

    def variant(k: str, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = F.get(f"{k}_sums", block).bitwiseXOR(_fold(F.slice(f"{k}_changed", block * BLOCK + 1, i % BLOCK)))
        return F.col(f"{k}_rest").bitwiseXOR(before).bitwiseXOR(F.get(f"{k}_moved", i))

    less = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(variant("a", i).alias("a"), variant("b", i).alias("b"), (i + 1).alias("pos"), (F.col("n") - 1).alias("n")))
    whole = F.array(F.struct(F.col("a_whole").alias("a"), F.col("b_whole").alias("b"), F.lit(0).alias("pos"), F.col("n").alias("n")))
    return keyed.select("at", F.explode(F.concat(whole, less)).alias("v")).select("v.a", "v.b", "v.n", "v.pos", "at")


def _same_but_one(x: Column, y: Column, pos: Column, replaced: Column) -> Column:
    """Whether x without its pos-th word is y, or is y without its pos-th word."""

    def less(words: Column) -> Column:
        return F.concat(F.slice(words, F.lit(1), pos - 1), F.slice(words, pos + 1, F.size(words)))

    return less(x) == F.when(replaced, less(y)).otherwise(y)


def near_lines(texts: DataFrame, keys: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places (at) of the lines of distinct (at, h1, h2) that have an earlier near line; keys has all lines' halves."""
    halves = keys.filter("halves is not null").select("h1", F.explode("halves").alias("half"))
    common = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low != high").select("half")
    wanted = halves.join(common, "half", "left_semi").select("h1").distinct()
    candidates = distinct.join(wanted, "h1", "left_semi").select("at")
    wanted = candidates.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row")).agg(F.collect_set("at.line_no").alias("wanted"))
    lines = texts.join(wanted, ["doc_id", "row"]).select("doc_id", "row", F.explode("wanted").alias("line_no"), F.split("text", "\n", -1).alias("lines"))
    lines = lines.select(F.struct("doc_id", "line_no", "row").alias("at"), F.split(_collapsed(F.get("lines", "line_no")), " ").alias("words"))
    lines = stored(lines.groupBy("at").agg(F.any_value("words").alias("words")), "candidate-lines")

    variants = _variants(lines)
    several = variants.groupBy("a", "b", "n").count().filter("count > 1").select("a", "b", "n")
    active = stored(variants.join(several, ["a", "b", "n"], "left_semi"), "line-variants")
    key = ["a", "b", "n"]
    less = active.filter("pos > 0")
    wholes = active.filter("pos = 0")
    replaced = less.join(less.groupBy(*key, "pos").agg(F.min("at").alias("first")), [*key, "pos"]).filter("first < at")
    longer = less.join(wholes.select(*key, F.col("at").alias("first")), key).filter("first < at")
    shorter = wholes.drop("pos").join(less.groupBy(*key).agg(F.min(F.struct("at", "pos")).alias("m")), key).filter("m.at < at")
    pairs = reduce(
        DataFrame.unionByName,
        [
            replaced.select("at", "first", "pos", F.lit("replaced").alias("how")),
            longer.select("at", "first", "pos", F.lit("longer").alias("how")),
            shorter.select("at", F.col("m.at").alias("first"), F.col("m.pos").alias("pos"), F.lit("shorter").alias("how")),
        ],
    )
    known = lines.select(F.col("at").alias("first"), F.col("words").alias("first_words"))
    compared = pairs.join(lines, "at").join(known, "first")
    swap = F.col("how") == "shorter"
    x, y = F.when(swap, F.col("first_words")).otherwise(F.col("words")), F.when(swap, F.col("words")).otherwise(F.col("first_words"))
    return compared.filter(_same_but_one(x, y, F.col("pos"), F.col("how") == "replaced")).select("at").distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(at, near) of the lines of docs (doc_id, row, text) that go."""
    keys = stored(line_keys(docs), "line-keys")
    distinct = keys.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("copies"))
    distinct = stored(distinct, "distinct-lines")
    copied = distinct.filter("copies > 1").select("h1", "h2", F.col("at").alias("first"))
    equal = keys.join(copied, ["h1", "h2"]).filter("at != first").select("at", F.lit(False).alias("near"))
    return equal.unionByName(near_lines(docs, keys, distinct).withColumn("near", F.lit(True)))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut down to the lines that stay, and the numbers of lines that went, n_equal and n_near.

    Lines end at a line feed; white space within a line doesn't tell lines apart; blank lines stay. No row goes: a
    document of repeated lines alone keeps an empty text. Null texts stay null. Rows that repeat a doc_id are told
    apart by their texts, and copies of a row under one doc_id keep and lose the same lines. Rows without doc_id are not
    compared and stay whole. An empty table gives no rows. Other columns are kept, save n_equal and n_near.
    """
    text = F.col("text").cast("string")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("row"), text.alias("text")).filter("doc_id is not null and text is not null")
    gone = repeated_lines(known).groupBy(F.col("at.doc_id").alias("__doc_id"), F.col("at.row").alias("__row")).agg(
        F.collect_set("at.line_no").alias("__gone"), F.count_if(~F.col("near")).alias("__equal"), F.count_if("near").alias("__near")
    )
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col("__doc_id")) & (F.hash(text) == F.col("__row")), "left")
    # A column of its own: inside the lambda the text would be split once a line.
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    columns = [c for c in docs.columns if c not in ("text", "n_equal", "n_near")]
    return joined.select(
        *(F.col(f"`{c}`") for c in columns),
        F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")).alias("text"),
        F.coalesce("__equal", F.lit(0)).alias("n_equal"),
        F.coalesce("__near", F.lit(0)).alias("n_near"),
    )
