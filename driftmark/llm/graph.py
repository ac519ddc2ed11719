"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.work import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (large) or smaller neighbours, and itself, to the smallest node it sees."""
    if large:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    joined = seen.join(least, "u")
    if large:
        tied = joined.filter("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:
        own = least.select(F.col("u").alias("a"), F.col("least").alias("b"))
        tied = joined.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(own)
    return tied.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b: longs); root is the smallest node that can be reached.

    Each round halves long chains and is written to the shared folder, so no lineage grows. Sums of a round's
    links tell whether it changed anything; nothing else comes to the driver.
    """
    mark = None
    links = stored(links.select("a", "b").filter("a != b").distinct(), "links")
    while True:
        links = stored(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
