"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of documents; the last
one returns the pieces of packed sequences. Every stage's rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import decontaminate, langid, line_dedup, packing, simhash
from driftmark.session import new_work_dir

LEAST_SCORE = 0.2  # of the language; every ordinary text is far above it


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.accepted(docs, LEAST_SCORE)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document or line has, equal or but for one word."""
    found = line_dedup.drop_repeated_lines(docs)
    n_chars = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c != "n_chars"), *n_chars).select(*(F.col(f"`{c}`") for c in docs.columns))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows without doc_id stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.passages(docs, benchmark).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col("__found"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language profiles, fingerprints and token ids can't be said in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
