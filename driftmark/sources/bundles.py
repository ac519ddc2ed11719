"""Landed resource bundles: JSON files, one page of a resource collection each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import variant as V


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """`(file, doc VARIANT)` of JSON files with one document each; a file that can't be read stops the job, by name."""
    return parse_documents(spark.read.text(path, wholetext=True))


def parse_documents(text: DataFrame) -> DataFrame:
    """The same from a frame of whole files, batch or stream."""
    docs = text.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    failed = F.raise_error(F.concat(F.lit("not a JSON document, or one of over 128 MiB: "), F.col("file"))).cast("boolean")
    return docs.filter(F.when(F.col("doc").isNull(), failed).otherwise(F.lit(True)))


def read_bundles(spark: SparkSession, path: str, page_digits: str = r"(\d+)\.json$") -> DataFrame:
    """`(pos, resource VARIANT)`: the object resources of all entries, anything else skipped.

    `pos` is the landing order: page number from the file name in the upper digits, place in the
    page in the lower ones.
    """
    docs = read_documents(spark, path)
    page = F.coalesce(F.regexp_extract("file", page_digits, 1).try_cast("bigint"), F.lit(0))
    entries = docs.select(page.alias("page"), F.posexplode(V.as_list(V.member(F.col("doc"), "entry"))).alias("place", "entry"))
    rows = entries.select(
        (F.col("page") * F.lit(1 << 32) + F.col("place")).alias("pos"), V.member(F.col("entry"), "resource").alias("resource")
    )
    return rows.filter(V.as_object(F.col("resource")).isNotNull())
