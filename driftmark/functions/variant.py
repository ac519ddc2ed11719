"""VARIANT documents: access, canonical form, tree walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,variant>"
LIST = "array<variant>"
# Pieces of a JSON text: strings, numbers, and what stands between them.
PIECES = r'"(?:[^"\\]++|\\.)*+"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[^"\d-]++'
UNEVEN_NUMBER = r"\d(?:\.\d|[eE][+-]?\d)"
STRING = r'"(?:[^"\\]++|\\.)*+"'
# What a display text is folded from: strings, other scalars and brackets.
DISPLAY_PIECES = STRING + r'|[{}\[\]]|[^"{}\[\],:]++'
OPEN_CONTAINERS = "array<struct<listed:boolean,key:string,parts:array<string>>>"
NO_BRACKETS = r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++'


def as_object(doc: Column) -> Column:
    """The members of an object, null for anything else."""
    return doc.try_cast(MAP)


def as_list(doc: Column) -> Column:
    return doc.try_cast(LIST)


def is_text(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc) == "STRING", F.lit(False))


def as_text(doc: Column) -> Column:
    """The string a document is, null when it is not a string."""
    return F.when(is_text(doc), doc.try_cast("string"))


def is_blank(doc: Column) -> Column:
    """Absent or JSON null."""
    return doc.isNull() | F.coalesce(F.is_variant_null(doc), F.lit(False))


def plain_number(number: Column) -> Column:
    """A JSON number without exponent, closing zeros of a fraction, or a sign of zero: equal text for equal numbers."""

    def digits(whole: Column, fraction: Column, exponent: Column) -> Column:
        return let(
            F.regexp_replace(F.concat(whole, fraction), "^0+", ""),
            lambda d: F.struct(F.regexp_replace(d, "0+$", "").alias("d"), (exponent - F.length(fraction) + F.length(d) - F.length(F.regexp_replace(d, "0+$", ""))).alias("e")),
        )

    def written(n: Column) -> Column:
        d, e = n["d"], n["e"]
        size = F.length(d)
        inside = F.concat(F.substr(d, F.lit(1), size + e), F.lit("."), F.substr(d, size + e + 1))
        return (
            F.when(size == 0, F.lit("0"))
            .when(e >= 0, F.concat(d, F.repeat(F.lit("0"), e)))
            .when(size + e > 0, inside)
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - size), d))
        )

    exponent = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    parts = digits(F.regexp_extract(number, r"^-?(\d+)", 1), F.regexp_extract(number, r"\.(\d+)", 1), exponent)
    shown = let(parts, written)
    return let(shown, lambda t: F.when(F.startswith(number, F.lit("-")) & (t != "0"), F.concat(F.lit("-"), t)).otherwise(t))


def canonical(doc: Column) -> Column:
    """Text that is equal for equal documents: keys sorted, numbers by value (`1.0`, `1e0` as `1`), list order kept."""
    evened = lambda t: F.array_join(
        F.transform(
            F.regexp_extract_all(t, F.lit(PIECES), F.lit(0)),
            lambda p: F.when(p.rlike("^-?[0-9]") & p.rlike(UNEVEN_NUMBER + "|^-0$"), plain_number(p)).otherwise(p),
        ),
        "",
    )
    text = let(F.to_json(doc), lambda t: F.when(t.rlike(UNEVEN_NUMBER), evened(t)).otherwise(t))
    return F.when(is_blank(doc), F.lit("null")).otherwise(text)


def depth(doc: Column) -> Column:
    """How many objects and lists lie in one another, at most; 0 for anything else."""
    brackets = F.split(F.regexp_replace(F.to_json(doc), NO_BRACKETS, ""), "")
    seen = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: let(
            a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0),
            lambda now: F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most")),
        ),
        lambda a: a["most"],
    )
    return F.coalesce(F.when(~is_blank(doc), seen), F.lit(0))


def measured_depth(df: DataFrame, *docs: str) -> int:
    """The depth of the deepest document in the columns; one aggregate over df, one number to the driver."""
    return df.agg(F.max(F.greatest(*[depth(F.col(d)) for d in docs], F.lit(0)))).first()[0] or 0


def at(doc: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path whose numeric parts index lists; missing parts give null."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.try_variant_get(doc, "$" + steps, kind)


def text_at(doc: Column, path: str) -> Column:
    return as_text(at(doc, path, "variant"))


def member(doc: Column, key: str) -> Column:
    return F.try_element_at(as_object(doc), F.lit(key))


def let(value: Column, body) -> Column:
    """`body(value)` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(doc: Column) -> Column:
    """Members of an object (key, value) or items of a list (null key, value) in one shape."""
    items = F.transform(
        as_list(doc), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value"))
    )
    return F.coalesce(items, F.map_entries(as_object(doc)))


def _scalar_text(doc: Column) -> Column:
    return (
        F.when(is_blank(doc), F.lit("None"))
        .when(F.schema_of_variant(doc) == "BOOLEAN", F.initcap(doc.try_cast("string")))
        .otherwise(F.trim(F.regexp_replace(doc.try_cast("string"), r"(?U)[\s\x1c-\x1f]+", " ")))
    )


def display_value(doc: Column, levels: int = 12) -> Column:
    """Display text in which the order of list items does not matter, at any depth.

    The first `levels` levels are nested transforms; what lies deeper is folded over its JSON pieces. The text is the
    same for any `levels`: the fold takes any depth, the transforms are faster on long lists.
    """
    scalar = _scalar_text(doc)
    if levels == 0:
        return F.when(_parts(doc).isNotNull(), _folded_display(doc)).otherwise(scalar)
    shown = F.transform(
        F.filter(_parts(doc), lambda m: m["key"].isNull() | ~is_blank(m["value"])),
        lambda m: F.concat(F.coalesce(F.concat(m["key"], F.lit(":")), F.lit("")), display_value(m["value"], levels - 1)),
    )
    listed = as_list(doc).isNotNull()
    text = let(shown, lambda p: _joined(listed, p))
    return F.when(listed | as_object(doc).isNotNull(), text).otherwise(scalar)


def _joined(listed: Column, parts: Column) -> Column:
    return F.array_join(F.when(listed, F.array_sort(parts)).otherwise(parts), "\n")


def _folded_display(doc: Column) -> Column:
    """The display text of an object or list by one pass over its JSON pieces, with the containers still open on a stack."""
    nothing = F.lit(None).cast("string")
    start = F.struct(F.array().cast(OPEN_CONTAINERS).alias("stack"), nothing.alias("key"), nothing.alias("text"))

    def state(stack: Column, key: Column, text: Column) -> Column:
        return F.struct(stack.alias("stack"), key.alias("key"), text.alias("text"))

    def container(listed: Column, key: Column, parts: Column) -> Column:
        return F.array(F.struct(listed.alias("listed"), key.alias("key"), parts.alias("parts")))

    def below(stack: Column) -> Column:
        return F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))

    def put(stack: Column, key: Column, text: Column, blank: Column) -> Column:
        """A finished value becomes a part of the container on top, or the result."""
        top = F.try_element_at(stack, F.lit(-1))
        part = F.when(top["listed"], text).when(~blank, F.concat(key, F.lit(":"), text))
        parts = F.when(part.isNull(), top["parts"]).otherwise(F.concat(top["parts"], F.array(part)))
        grown = F.concat(below(stack), container(top["listed"], top["key"], parts))
        return F.when(F.size(stack) == 0, state(stack, nothing, text)).otherwise(state(grown, nothing, nothing))

    def step(s: Column, piece: Column) -> Column:
        stack, top = s["stack"], F.try_element_at(s["stack"], F.lit(-1))
        opened = F.concat(stack, container(piece == "[", s["key"], F.array().cast("array<string>")))
        names_a_member = ~top["listed"] & s["key"].isNull()
        value = lambda v: F.when(names_a_member, state(stack, v.try_cast("string"), nothing)).otherwise(
            put(stack, s["key"], _scalar_text(v), is_blank(v))
        )
        return (
            F.when(piece.isin("{", "["), state(opened, nothing, nothing))
            .when(piece.isin("}", "]"), put(below(stack), top["key"], _joined(top["listed"], top["parts"]), F.lit(False)))
            .otherwise(let(F.parse_json(piece), value))
        )

    pieces = F.regexp_extract_all(F.to_json(doc), F.lit(DISPLAY_PIECES), F.lit(0))
    return F.aggregate(pieces, start, step, lambda s: s["text"])


def json_text(doc: Column) -> Column:
    """JSON with sorted keys and a blank after `,` and `:`, the form values take in summaries."""
    spaced = lambda p: F.replace(F.replace(p, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    pieces = F.regexp_extract_all(F.to_json(doc), F.lit(STRING + r'|[^"]++'), F.lit(0))
    text = F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(spaced(p))), "")
    return F.when(is_blank(doc), F.lit("null")).otherwise(text)


def walk(df: DataFrame, doc: str, max_depth: int | None = None, leaves_only: bool = False) -> DataFrame:
    """One row per node: `path array<string>`, `node_pos array<int>` (sort by it for document order), `node`.

    A chain of narrow generators, one per level, so no level is evaluated twice and nothing is
    shuffled.  There are as many levels as the deepest document has, measured first by one aggregate; with
    a `max_depth` of the caller's, deeper documents stop the job instead of losing nodes.
    """
    if max_depth is None:
        max_depth = measured_depth(df, doc)
    keep = [c for c in df.columns if c != doc]
    rows = df.select(
        *keep,
        F.array().cast("array<string>").alias("path"),
        F.array().cast("array<int>").alias("node_pos"),
        F.col(doc).alias("node"),
        F.lit(True).alias("__open"),
    ).filter(F.col("node").isNotNull())
    for _ in range(max_depth):
        members, items = as_object(F.col("node")), as_list(F.col("node"))
        of_object = F.transform(
            F.map_entries(members),
            lambda e, i: F.struct(
                F.concat("path", F.array(e["key"])).alias("path"),
                F.concat("node_pos", F.array(i)).alias("node_pos"),
                e["value"].alias("node"),
                F.lit(True).alias("__open"),
            ),
        )
        of_list = F.transform(
            items,
            lambda v, i: F.struct(
                F.concat("path", F.array(i.cast("string"))).alias("path"),
                F.concat("node_pos", F.array(i)).alias("node_pos"),
                v.alias("node"),
                F.lit(True).alias("__open"),
            ),
        )
        itself = F.array(F.struct("path", "node_pos", "node", F.lit(False).alias("__open")))
        opened = rows.withColumn("__nested", F.when(F.col("__open"), F.coalesce(of_object, of_list)))
        below = F.col("__nested") if leaves_only else F.concat(itself, "__nested")
        step = F.when(F.col("__nested").isNotNull(), below).otherwise(itself)
        rows = opened.select(*keep, F.explode(step).alias("__n")).select(*keep, "__n.*")
    deeper = F.col("__open") & (as_object(F.col("node")).isNotNull() | as_list(F.col("node")).isNotNull())
    guard = F.when(deeper, F.raise_error(F.lit("document nested deeper than walk(max_depth)")).cast("boolean")).otherwise(
        F.lit(True)
    )
    return rows.filter(guard).drop("__open")


def text_leaves(df: DataFrame, doc: str, max_depth: int | None = None) -> DataFrame:
    """String leaves with their path: the `path`, `node_pos` and `text` of each."""
    rows = walk(df, doc, max_depth, leaves_only=True)
    return rows.withColumn("text", as_text(F.col("node"))).filter(F.col("text").isNotNull()).drop("node")
