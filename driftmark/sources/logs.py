"""Append-only logs: scan history and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import times as D
from driftmark.functions import variant as V
from driftmark.sources.bundles import read_documents

HISTORY = "scan_timestamp timestamp, number_of_entities bigint, changes_detected bigint, scan_duration_seconds double"
DIGESTS = "sent_at string, recipient string, number_of_changes bigint, subject string, status string, error_message string"


def append_log(row: DataFrame, root: str, name: str, batch: str) -> None:
    """Append one log row under its batch id, so a repeated batch does not log twice."""
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch}")


def read_log(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A log, empty before its first row."""
    try:
        return spark.read.option("basePath", f"{root}/{name}").schema(schema + ", batch_id string").parquet(f"{root}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema + ", batch_id string")


def read_history_file(spark: SparkSession, path: str, entities_key: str) -> DataFrame:
    """History rows of a JSON list file; `entities_key` is its name for the number of entities."""
    rows = read_documents(spark, path).select(F.explode(V.as_list(F.col("doc"))).alias("row"))
    row = F.col("row")
    return rows.filter(V.as_object(row).isNotNull()).select(
        D.parse_time(V.at(row, "scan_timestamp")).alias("scan_timestamp"),
        V.at(row, entities_key, "bigint").alias("number_of_entities"),
        V.at(row, "changes_detected", "bigint").alias("changes_detected"),
        V.at(row, "scan_duration_seconds", "double").alias("scan_duration_seconds"),
    )
