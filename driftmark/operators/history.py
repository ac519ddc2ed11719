"""Scan history and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_row(numbers: DataFrame, scan_timestamp: str, duration_seconds: float) -> DataFrame:
    """One history row from `(number_of_entities, changes_detected)`; durations keep three digits."""
    return numbers.select(
        F.lit(scan_timestamp).cast("timestamp").alias("scan_timestamp"),
        F.col("number_of_entities").cast("bigint").alias("number_of_entities"),
        F.col("changes_detected").cast("bigint").alias("changes_detected"),
        F.round(F.lit(duration_seconds), 3).alias("scan_duration_seconds"),
    )


def daily_statistics(history: DataFrame) -> DataFrame:
    """Per day: scans, entities seen, changes, and the spread of durations."""
    return history.groupBy(F.to_date("scan_timestamp").alias("scan_date")).agg(
        F.count(F.lit(1)).alias("scans"),
        F.max("number_of_entities").alias("entities"),
        F.sum("changes_detected").alias("changes_detected"),
        F.round(F.avg("scan_duration_seconds"), 3).alias("mean_duration"),
        F.max("scan_duration_seconds").alias("max_duration"),
    )
