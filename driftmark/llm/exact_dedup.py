"""Exact duplicates of long texts by content-defined chunk recipes, in DataFrame functions only.

A text, without its ASCII white space, is cut where its own characters say so, hence copies are cut alike. A chunk
is named by 64 bits, and the names are verified: the distinct pairs of name and SHA-256 digest show each name that
two contents share, and such contents are told apart by a number added to the name. A document is then the ordered
list of its chunk identifiers, 8 bytes for some hundred characters. Only these lists are shuffled and compared;
the texts themselves never leave the task that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.work import stored

SPACES = r"[\x20\x09-\x0D]"
LEAST, MOST = 128, 4096  # characters of a chunk
#: Characters after which a chunk may end if the second and fourth before them are of the same kind: every eighth code point.
MARK = "[" + "".join(rf"\u{c:04x}" for c in range(0x21, 0x250) if c % 8 == 1) + "]"
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?<={MARK}.{MARK}.{MARK})|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES + "+", "")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text in order."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text_sha256, names and digests (of the chunks, in order) of each row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    cut = texts.select("doc_id", "n_chars", F.sha2(F.col("norm"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    return cut.select(
        "doc_id",
        "n_chars",
        "text_sha256",
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("names"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def shared_names(recipe: DataFrame) -> DataFrame:
    """(name, digest, variant) of each name that belongs to several contents; no rows as a rule."""
    pair = recipe.select(F.explode(F.arrays_zip("names", "digests")).alias("c")).select("c.names", "c.digests").distinct()
    several = pair.groupBy("names").count().filter("count > 1").select("names")
    order = Window.partitionBy("names").orderBy("digests")
    return pair.join(several, "names", "left_semi").select(F.col("names").alias("name"), F.col("digests").alias("digest"), F.row_number().over(order).alias("variant"))


def identifier_lists(recipe: DataFrame, shared: DataFrame) -> DataFrame:
    """recipe's rows with ids, the verified identifiers in order.

    Only rows that hold a name of several contents are opened up; their identifiers are followed by the
    variants, as negative numbers, after the names.
    """
    if not shared.take(1):
        return recipe.select("doc_id", "n_chars", "text_sha256", F.col("names").alias("ids"))
    # Rows are told apart by their text's digest; rows of equal digest have equal chunks.
    opened = recipe.select("text_sha256", F.posexplode(F.arrays_zip("names", "digests")).alias("pos", "c")).select(
        "text_sha256", "pos", F.col("c.names").alias("name"), F.col("c.digests").alias("digest")
    )
    variants = (
        opened.join(shared, ["name", "digest"])
        .select("text_sha256", "pos", "variant")
        .distinct()
        .groupBy("text_sha256")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "variant"))), lambda v: -v["variant"].cast("long")).alias("variants"))
    )
    return recipe.join(variants, "text_sha256", "left").select(
        "doc_id", "n_chars", "text_sha256", F.when(F.col("variants").isNull(), F.col("names")).otherwise(F.concat("names", "variants")).alias("ids")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same without ASCII white space. Of equal texts the row with the most code points
    stays, then the smallest doc_id (null is larger than any). Null and empty texts, and texts of white space alone, are
    one group. Rows that repeat a doc_id are rows of their own in group_size; they are kept or dropped together.
    Other columns are not read, and an empty table gives no rows. Groups are reduced to one row before the shuffle;
    only lists that occur more than once are joined back, by a join that adaptive execution may split.
    """
    recipe = stored(recipes(docs), "recipes")
    lists = identifier_lists(recipe, shared_names(recipe)).withColumn("key", F.xxhash64("ids"))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = lists.groupBy("key", "ids").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    kept = groups.select("key", "ids", F.col("best.doc_id").alias("best_id"), "group_size")
    joined = lists.join(kept, ["key", "ids"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
