"""Money that is written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.text import strip
from driftmark.presets import AMOUNT_IN_TEXT, AMOUNT_WITH_CURRENCY


def amount_text(value: Column) -> Column:
    """`12,5` as `12.5`, `12.0` as `12`."""
    stripped = strip(value)
    return F.when(F.endswith(stripped, F.lit(".0")), F.regexp_replace(stripped, r"\.0$", "")).otherwise(
        F.replace(stripped, F.lit(","), F.lit("."))
    )


def amounts_in_text(text: Column) -> Column:
    """All `amount currency` mentions of a text, distinct, in order."""
    amounts = F.regexp_extract_all(text, F.lit(AMOUNT_IN_TEXT), F.lit(1))
    currencies = F.regexp_extract_all(text, F.lit(AMOUNT_IN_TEXT), F.lit(2))
    joined = F.zip_with(
        amounts,
        currencies,
        lambda a, c: F.concat(amount_text(a), F.lit(" "), F.when(F.upper(c) == "EUR", F.lit("EUR")).otherwise(c)),
    )
    return F.array_distinct(joined)


def amount_sort_key(value: Column) -> Column:
    """Six decimals for a number, lower-case text otherwise."""
    text = F.replace(strip(value), F.lit(","), F.lit("."))
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.6f", number)).otherwise(F.lower(text))


def split_amount(value: Column) -> Column:
    """struct(amount, currency) of `589,00 €`; no currency leaves the whole text as amount."""
    found = value.rlike(AMOUNT_WITH_CURRENCY)
    amount = F.regexp_extract(value, AMOUNT_WITH_CURRENCY, 1)
    currency = F.upper(F.regexp_extract(value, AMOUNT_WITH_CURRENCY, 2))
    present = F.coalesce(value, F.lit("")) != ""
    return F.struct(
        F.when(present & found, amount_sort_key(amount)).when(present, amount_sort_key(value)).alias("amount"),
        F.when(
            present & found, F.when(currency == "€", F.lit("EUR")).otherwise(currency)
        ).alias("currency"),
    )
