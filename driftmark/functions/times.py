"""Timestamps kept as ISO text, parsed on use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark import presets

ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_time(text: Column) -> Column:
    """ISO text to timestamp; no offset means UTC, anything unparsable is null.

    The session time zone has to be UTC, as `build_session` sets it.
    """
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def local_time(ts: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    return F.from_utc_timestamp(ts, timezone)


def local_date(ts: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    return F.to_date(local_time(ts, timezone))


def format_time(ts: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    return F.date_format(local_time(ts, timezone), "dd.MM.yyyy HH:mm")


def format_time_text(text: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    """Local display form of an ISO text; unparsable text stays as it is."""
    return F.coalesce(format_time(parse_time(text), timezone), text, F.lit(""))


def date_sort_key(value: Column) -> Column:
    """First ten characters of an ISO date or time, else the text itself, null as empty."""
    return F.when(value.rlike(ISO_DATE), F.substring(value, 1, 10)).otherwise(F.coalesce(value, F.lit("")))


def local_date_key(value: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    """Display variant: a leading valid date wins, another parsable time becomes a local date."""
    leading = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))
    parsed = F.coalesce(leading, local_time(parse_time(value), timezone))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), value, F.lit(""))


def format_date(value: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    """`dd.MM.yyyy` of a date or time text, the text itself when it is neither, null when empty."""
    leading = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))
    parsed = F.coalesce(leading, local_time(parse_time(value), timezone))
    return F.coalesce(F.date_format(parsed, "dd.MM.yyyy"), F.nullif(value, F.lit("")))


def validity(start: Column, end: Column) -> Column:
    phrases = presets.VALIDITY
    has_start, has_end = F.coalesce(start, F.lit("")) != "", F.coalesce(end, F.lit("")) != ""
    return (
        F.when(has_start & has_end, F.format_string(phrases["both"], start, end))
        .when(has_start, F.format_string(phrases["start"], start))
        .when(has_end, F.format_string(phrases["end"], end))
        .otherwise(F.lit(phrases["none"]))
    )


def update_notice(last_updated: Column, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    """Notice phrase in local time of an explicit zone."""
    local = local_time(parse_time(last_updated), timezone)
    phrase = F.format_string(
        presets.UPDATE_NOTICE, F.date_format(local, "dd.MM.yyyy"), F.date_format(local, "HH:mm")
    )
    raw = F.format_string(presets.UPDATE_NOTICE_RAW, last_updated)
    present = F.nullif(last_updated, F.lit(""))
    return F.when(present.isNull(), F.lit(None).cast("string")).when(local.isNotNull(), phrase).otherwise(raw)


def compact_timestamp(text: Column) -> Column:
    """Timestamp text without punctuation, as used in batch names."""
    return F.regexp_replace(text, "[:\\-.+Z]", "")


def snapshot_time(name: Column) -> Column:
    """Timestamp carried by a snapshot name such as `..._20260602T130102618820Z`."""
    digits = F.regexp_extract(name, r"(\d{8}T\d{6})(\d{6})Z", 0)
    second = F.try_to_timestamp(F.substring(digits, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    micros = F.substring(digits, 16, 6).try_cast("bigint")
    return F.timestamp_micros(F.unix_micros(second) + micros)


def path_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
