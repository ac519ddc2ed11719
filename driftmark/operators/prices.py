"""Prices: normal form, order-insensitive comparison, and the verdict on a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import money as M
from driftmark.functions import text as X
from driftmark.functions import times as D
from driftmark.functions import variant as V

AMOUNT, PERIOD, ORDER, OPAQUE = "amount", "period", "order", "opaque"


# ---- relational form: one row per price line -------------------------------------------------------


def compare_price_lines(before: DataFrame, after: DataFrame, key: str, line: Sequence[str], position: str, all_entities: bool = False) -> DataFrame:
    """Verdict per entity over price lines `(key, amount, start, end, currency, position)`.

    Lists are never gathered.  Equal lines of both sides cancel out in one aggregate per
    `(entity, line)`, amounts in a second one per `(entity, amount)`, so a single entity with a
    large share of all lines is spread by its lines.  The verdict is `amount`, `period` or `order`;
    entities whose lists are equal item by item are left out, or get `order` too with `all_entities`.
    """

    sides = before.withColumn("__side", F.lit(0)).unionByName(after.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return _compare_sides(sides, key, line, position, all_entities)


def _compare_sides(sides: DataFrame, key: str, line: Sequence[str], position: str, all_entities: bool) -> DataFrame:
    """The verdicts over both sides in one frame, told apart by `__side` 0 and 1."""
    is_before = F.col("__side") == 0
    sign = F.when(is_before, 1).otherwise(-1) * F.xxhash64(position, *line).cast("decimal(38,0)")
    lines = sides.groupBy(key, *line).agg(
        F.count_if(is_before).alias("b"), F.count_if(~is_before).alias("a"), F.sum(sign).alias("placed")
    )
    amount = line[0]
    amounts = lines.groupBy(key, amount).agg(
        F.sum("b").alias("b"),
        F.sum("a").alias("a"),
        F.max(F.col("b") != F.col("a")).alias("lines_differ"),
        F.sum("placed").alias("placed"),
    )
    one_sided = (F.coalesce(F.col(amount), F.lit("")) != "") & ((F.col("b") == 0) | (F.col("a") == 0))
    entities = amounts.groupBy(key).agg(
        F.sum("b").alias("lines_before"),
        F.sum("a").alias("lines_after"),
        F.max(one_sided).alias("amounts_differ"),
        F.max("lines_differ").alias("periods_differ"),
        (F.sum("placed") != 0).alias("order_differs"),
    )
    verdict = F.when(F.col("amounts_differ"), AMOUNT).when(F.col("periods_differ"), PERIOD).when(F.col("order_differs") | F.lit(all_entities), ORDER)
    return (
        entities.withColumn("verdict", verdict)
        .filter(F.col("verdict").isNotNull())
        .select(key, "lines_before", "lines_after", "verdict", F.col("verdict").isin(AMOUNT, PERIOD).alias("visible"))
    )


# ---- document form: price lists inside one VARIANT value -----------------------------------------------


def price_lines(df: DataFrame, doc: str, keys: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Rows `(keys, position, amount, start, end, currency, amount_text, raw_start, raw_end)` of a price document.

    The first period object and the first amount of each list item count, in canonical key order;
    amounts given as value and currency come before amounts found in text.
    """
    items = F.when(V.is_blank(F.col(doc)), F.array().cast(V.LIST)).otherwise(
        F.coalesce(V.as_list(F.col(doc)), F.array(F.col(doc)))
    )
    rows = df.select(*keys, F.posexplode(items).alias("position", "__item")).filter(V.as_object(F.col("__item")).isNotNull())
    nodes = V.walk(rows, "__item", max_depth)
    node = F.col("node")
    period = F.coalesce(*[_period(V.member(node, name)) for name in presets.PERIOD_KEYS])
    value, currency = V.member(node, "value"), V.member(node, "currency")
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|STRING)$")
    named = F.when(
        ~V.is_blank(currency) & (currency.try_cast("string") != "") & numeric,
        F.concat(M.amount_text(value.try_cast("string")), F.lit(" "), currency.try_cast("string")),
    )
    mention = X.truthy(F.try_element_at(M.amounts_in_text(V.as_text(node)), F.lit(1)))
    picked = nodes.groupBy(*keys, "position").agg(
        F.min_by(period, F.when(period.isNotNull(), F.col("node_pos"))).alias("p"),
        F.min_by(named, F.when(named.isNotNull(), F.col("node_pos"))).alias("named"),
        F.min_by(mention, F.when(mention.isNotNull(), F.col("node_pos"))).alias("mention"),
    )
    text = F.coalesce("named", "mention")
    split = M.split_amount(text)
    return picked.select(
        *keys,
        "position",
        F.coalesce(split["amount"], F.lit("")).alias("amount"),
        D.date_sort_key(F.col("p.start")).alias("start"),
        D.date_sort_key(F.col("p.end")).alias("end"),
        F.coalesce(split["currency"], F.lit("")).alias("currency"),
        text.alias("amount_text"),
        F.col("p.start").alias("raw_start"),
        F.col("p.end").alias("raw_end"),
    )


def _period(doc: Column) -> Column:
    start, end = V.at(doc, "start"), V.at(doc, "end")
    named = (F.coalesce(start, F.lit("")) != "") | (F.coalesce(end, F.lit("")) != "")
    return F.when(V.as_object(doc).isNotNull() & named, F.struct(start.alias("start"), end.alias("end")))


def price_document_verdicts(changes: DataFrame, keys: Sequence[str], before: str = "before", after: str = "after") -> DataFrame:
    """`(keys, verdict, visible, semantic)` of price changes given as VARIANT pairs.

    Without any price line on either side the verdict is `opaque`: not visible in the feed, and
    semantic when the documents differ.
    """
    line = ["amount", "start", "end", "currency"]
    each = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col(before).alias("d")), F.struct(F.lit(1).alias("s"), F.col(after).alias("d"))))
    docs = changes.select(*keys, each.alias("x")).select(*keys, F.col("x.s").alias("__side"), F.col("x.d").alias("doc"))
    lines = price_lines(docs.filter(~V.is_blank(F.col("doc"))), "doc", [*keys, "__side"])
    # The amount that is shown has its currency, so a change of currency is a change of amount.
    shown = F.when(F.col("amount") != "", F.concat_ws(" ", "amount", "currency")).otherwise("")
    known = _compare_sides(lines.withColumn("__key", F.struct(*keys)).withColumn("amount", shown), "__key", line, "position", True).select(
        *[F.col(f"__key.{k}").alias(k) for k in keys], "verdict"
    )
    judged = changes.join(known, list(keys), "left").withColumn("verdict", F.coalesce("verdict", F.lit(OPAQUE)))
    opaque_differs = (F.col("verdict") == OPAQUE) & (V.canonical(F.col(before)) != V.canonical(F.col(after)))
    return judged.withColumn("visible", F.col("verdict").isin(AMOUNT, PERIOD)).withColumn(
        "semantic", F.col("visible") | opaque_differs
    )


def verdict_title(verdict: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in presets.PRICE_VERDICTS.items() for x in pair])
    return F.element_at(table, verdict)


def price_text(lines: DataFrame, timezone: str = presets.DISPLAY_TIMEZONE) -> Column:
    """Readable line for one price row (`number` is its place in the sorted list)."""
    amount = F.coalesce(X.truthy(F.col("amount_text")), F.lit(presets.PRICE_MISSING))
    valid = D.validity(D.format_date(F.col("raw_start"), timezone), D.format_date(F.col("raw_end"), timezone))
    return F.format_string(presets.PRICE_LINE, F.col("number"), amount, valid)
