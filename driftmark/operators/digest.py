"""The digest: numbers, period and the first lines of a batch of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import text as X
from driftmark.functions import times as D
from driftmark.operators import events as E
from driftmark.operators import textdiff as W


def digest_numbers(events: DataFrame) -> DataFrame:
    """Event count, earliest known and latest new state, and the subject line."""
    current = F.coalesce(X.truthy(F.col("current_snapshot_ts")), F.col("detected_at"))
    return events.agg(
        F.count(F.lit(1)).alias("number_of_changes"),
        F.min(D.parse_time(F.col("previous_snapshot_ts"))).alias("previous_state"),
        F.max(D.parse_time(current)).alias("current_state"),
    ).withColumn("subject", F.format_string(presets.DIGEST_SUBJECT, F.col("number_of_changes")))


def mail_label(events: DataFrame) -> Column:
    own = X.truthy(F.col("field_label")) if "field_label" in events.columns else F.lit(None).cast("string")
    return F.coalesce(own, X.label_for(F.col("field"), presets.MAIL_FIELD_LABELS))


def digest_lines(events: DataFrame, limit: int = 10) -> DataFrame:
    """The first events (by `seq`) with their line parts; a top-k, so every task keeps `limit` rows."""
    first = events.orderBy("seq").limit(limit)
    summary = X.truthy(F.col("summary")) if "summary" in events.columns else F.lit(None).cast("string")
    kind = F.col("text_change_kind") if "text_change_kind" in events.columns else F.lit(None).cast("string")
    out = first.select(
        "seq",
        F.coalesce("entity_name", F.lit(presets.UNKNOWN_ENTITY)).alias("entity_name"),
        E.change_label(F.col("change_type"), presets.MAIL_CHANGE_LABEL_DEFAULT).alias("change_label"),
        mail_label(events).alias("area"),
        F.coalesce(summary, E.short_description(F.col("change_type"), kind)).alias("description"),
        *([F.col("change_type"), kind.alias("kind"), F.col("word_diff")] if "word_diff" in events.columns else []),
    )
    if "word_diff" not in events.columns:
        return out
    textual = F.col("change_type") == presets.TEXT
    phrase = lambda op, but: X.truthy(
        F.when(textual & (F.coalesce("kind", F.lit("")) != but), W.first_changed_phrase(F.col("word_diff"), op))
    )
    return (
        out.withColumn("removed_phrase", phrase("delete", "text_added"))
        .withColumn("added_phrase", phrase("insert", "text_removed"))
        .drop("change_type", "kind", "word_diff")
    )


def digest_log_row(numbers: DataFrame, sent_at: str, status: str, recipient: str = "", error: str | None = None) -> DataFrame:
    """The log row of one digest."""
    return numbers.select(
        F.lit(sent_at).alias("sent_at"),
        F.lit(recipient).alias("recipient"),
        "number_of_changes",
        "subject",
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"),
    )
