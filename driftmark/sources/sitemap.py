"""Directory URLs from a sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions.text import strip
from driftmark.operators.assembly import id_from_url


def read_sitemap(spark: SparkSession, path: str, pattern: str = presets.DIRECTORY_URL_PATTERN) -> DataFrame:
    """`(entity_id, entity_url)` of the `<loc>` entries that match the pattern, each once."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return directory_urls(rows, strip(F.col("loc")), pattern)


def directory_urls(df: DataFrame, url: Column, pattern: str) -> DataFrame:
    urls = df.select(url.alias("entity_url")).filter(F.col("entity_url").rlike(pattern)).distinct()
    return urls.select(id_from_url(F.col("entity_url")).alias("entity_id"), "entity_url")
