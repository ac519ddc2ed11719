"""The last known row of every key, kept so that a batch costs what it touches.

Keys lie in buckets by the leading bits of their hash. A bucket that outgrows its limit is split by the next bits when it
is written, so buckets stay small however many keys there are, and a batch reads and writes the buckets of its own
keys alone. A manifest says which batch wrote each bucket last.

Layout: ``<root>/buckets/batch_id=N/bits=..../`` holds rows `(key, h, value)`, and ``<root>/manifest/batch_id=N`` one
row per bucket after batch N. The manifest of a batch is one file and is written last: readers see a batch as a whole or not
at all, and a batch that runs again reads the manifest before its own and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 40  # of a key's hash
BUCKET_ROWS = 50_000  # a bucket with more rows is split
MANIFEST = "bits string, written bigint, rows bigint, batch_id bigint"


class KeyedState:
    """State below `root` of rows `(key, value)`; value is of the DDL type `value_type`. Null keys are keys like any other."""

    def __init__(self, spark: SparkSession, root: str, key_type: str, value_type: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows
        self.row = f"key {key_type}, h bigint, value {value_type}"
        # The manifest of no batch has no bucket. Writing it again changes nothing.
        empty = spark.createDataFrame([], "bits string, written bigint, rows bigint")
        empty.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch_id=-1")

    def manifest(self, before: int | None = None) -> DataFrame:
        """`(bits, written, rows)` of every bucket after the last batch (before a given one)."""
        every = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        if before is not None:
            every = every.filter(F.col("batch_id") < before)
        last = every.agg(F.max("batch_id").alias("last")).scalar()
        return every.filter(F.col("batch_id") == last).select("bits", "written", "rows")

    @staticmethod
    def hashed(key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)

    @staticmethod
    def leading(h: Column, depth: Column) -> Column:
        return F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth)

    def touched(self, keys: DataFrame, before: int) -> list:
        """The buckets `(bits, written, rows)` that the keys lie in; as many rows at most as there are keys."""
        manifest = self.manifest(before)
        depths = [r.depth for r in manifest.select(F.length("bits").alias("depth")).distinct().collect()]  # BITS at most
        if not depths:
            return []
        h = self.hashed(F.col("key"))
        bits = keys.select(F.explode(F.array(*[self.leading(h, F.lit(d)) for d in depths])).alias("bits")).distinct()
        return manifest.join(bits, "bits", "left_semi").collect()

    def read(self, buckets: list) -> DataFrame:
        """`(key, h, value, bits)` of some buckets; files of others are not opened."""
        if not buckets:
            return self.spark.createDataFrame([], self.row + ", bits string")
        paths = [f"{self.root}/buckets/batch_id={b.written}/bits=b{b.bits}" for b in buckets]
        rows = self.spark.read.schema(self.row + ", bits string").option("basePath", f"{self.root}/buckets").parquet(*paths)
        return rows.select("key", "h", "value", F.substring("bits", 2, BITS).alias("bits"))

    def all(self) -> DataFrame:
        """`(key, value)` of every key after the last batch."""
        return self.read(self.manifest().collect()).select("key", "value")

    def write(self, batch_id: int, fresh: DataFrame, buckets: list) -> None:
        """Put fresh `(key, value)`, one row per key, over the rows of the touched buckets, and commit.

        fresh must hold keys of these buckets only, or of no bucket yet where the state has none.
        """
        known = [b.bits for b in buckets] or [""]
        h = self.hashed(F.col("key"))
        depth_of = F.array(*[F.lit(d) for d in sorted({len(b) for b in known})])
        table = self.spark.createDataFrame([(b,) for b in known], "bits string")
        placed = fresh.select("key", h.alias("h"), "value").withColumn("bits", F.explode(F.transform(depth_of, lambda d: self.leading(F.col("h"), d))))
        placed = placed.join(table, "bits", "left_semi").select("key", "h", "value", "bits")
        held = self.read(buckets)
        other = held.join(fresh.select(F.col("key").alias("__key")), F.col("key").eqNullSafe(F.col("__key")), "left_anti")
        rows = placed.unionByName(other)
        sizes = rows.groupBy("bits").agg(F.count("*").alias("n"))  # a row per touched bucket
        deeper = F.ceil(F.log2(F.greatest(F.col("n") / self.bucket_rows, F.lit(1.0)))).cast("int")
        split = rows.join(sizes, "bits").withColumn("bits", self.leading(F.col("h"), F.least(F.length("bits") + deeper, F.lit(BITS))))
        split = split.select("key", "h", "value", F.concat(F.lit("b"), "bits").alias("bits"))
        folder = f"{self.root}/buckets/batch_id={batch_id}"
        split.repartition("bits").write.mode("overwrite").partitionBy("bits").parquet(folder)
        written = self.spark.read.schema("h bigint, bits string").parquet(folder).groupBy(F.substring("bits", 2, BITS).alias("bits"))
        now = written.agg(F.lit(batch_id).cast("bigint").alias("written"), F.count("*").alias("rows"))
        kept = self.manifest(batch_id).join(table, "bits", "left_anti")
        kept.unionByName(now).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch_id={batch_id}")
