"""Text columns: whitespace, words, labels, slugs, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark import presets

# Unicode white space plus the four ASCII separators that text splitting also breaks on.
SPACES = r"(?U)[\s\x1c-\x1f]+"
EDGE_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACES, "")


def clean_text(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def has_text(text: Column) -> Column:
    """Something other than white space in it; stops at the first such character."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def normalize_text(text: Column) -> Column:
    """`clean_text` in lower case, the form texts are compared in."""
    return clean_text(F.lower(text))


def words(text: Column) -> Column:
    return F.filter(F.split(clean_text(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    cleaned = clean_text(text)
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " ")))


def truthy(text: Column) -> Column:
    """Null for the empty string, the text otherwise."""
    return F.nullif(text, F.lit(""))


def first_truthy(*texts: Column) -> Column:
    return F.coalesce(*[truthy(t) for t in texts])


def first_text(*texts: Column) -> Column:
    """The first text with something other than white space in it, cleaned."""
    return F.coalesce(*[truthy(clean_text(t)) for t in texts])


def first_item_text(items: Column) -> Column:
    """`first_text` over an array of strings."""
    return F.try_element_at(F.filter(F.transform(items, clean_text), lambda t: t != ""), F.lit(1))


def distinct_truthy(items: Column) -> Column:
    """Distinct non-empty items in order of first appearance."""
    return F.array_distinct(F.filter(items, lambda t: t.isNotNull() & (t != "")))


def strip_leading_label(text: Column, limit: int = presets.LABEL_COLON_LIMIT) -> Column:
    """Drop `label:` when the first colon stands within the first `limit` characters."""
    stripped = strip(text)
    at = F.instr(stripped, ":")
    return F.when(at.between(1, limit + 1), strip(F.substr(stripped, at + 1))).otherwise(stripped)


def slugify(text: Column, fallback: str = presets.SLUG_FALLBACK) -> Column:
    folded = F.lower(strip(text))
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(umlaut), F.lit(plain))
    dashed = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(truthy(F.substring(dashed, 1, 80)), F.lit(fallback))


def safe_name(text: Column, fallback: str = presets.SLUG_FALLBACK) -> Column:
    cleaned = F.regexp_replace(strip(text), "[^A-Za-z0-9_-]+", "_")
    return F.coalesce(truthy(F.regexp_replace(cleaned, "^_+|_+$", "")), F.lit(fallback))


def key_part(text: Column) -> Column:
    """Slug with a short digest of itself, the path part of a section key."""
    slug = slugify(text)
    return F.concat(slug, F.lit("-"), F.substring(F.sha1(slug), 1, 10))


def stable_key_part(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact(text: Column, limit: int = 500) -> Column:
    """At most `limit` characters, with `...` when something was cut."""
    cleaned = clean_text(text)
    cut = F.concat(F.regexp_replace(F.substring(cleaned, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(cleaned) <= limit, cleaned).otherwise(cut)


def first_words(text: Column, limit: int = 36) -> Column:
    """The text when short, else its first words and ` ...`."""
    parts = words(text)
    head = F.concat(F.array_join(F.slice(parts, 1, limit), " "), F.lit(" ..."))
    return F.when(F.size(parts) <= limit, text).otherwise(head)


def preview(text: Column, limit: int = 240) -> Column:
    """Section preview: the text, or its first `limit - 3` characters and `...`."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )


def contains_any(text: Column, markers) -> Column:
    """True when one of the given plain strings occurs in the text."""
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(text, F.lit(marker))
    return hit


def question_label(label: Column) -> Column:
    """Readable label of the one long questionnaire item the registry shows under a short name."""
    lowered = F.lower(label)
    known = F.lit(True)
    for word in presets.PROFILE_QUESTION_WORDS:
        known = known & F.contains(lowered, F.lit(word))
    return F.when(known, F.lit(presets.PROFILE_QUESTION_LABEL)).otherwise(label)


def display_path(path: Column) -> Column:
    """Normalised `a > b > c`: blank parts dropped, the known question renamed."""
    parts = F.filter(F.transform(F.split(path, " > "), strip), lambda p: p != "")
    return F.array_join(F.transform(parts, question_label), " > ")


def path_title(path: Column) -> Column:
    """Last part of a display path (the whole path when it has one part)."""
    parts = F.filter(F.transform(F.split(path, " > "), strip), lambda p: p != "")
    return F.when(F.size(parts) >= 2, question_label(F.element_at(parts, -1))).otherwise(path)


def path_parents(path: Column) -> Column:
    """Everything before the title, or null."""
    parts = F.filter(F.transform(F.split(path, " > "), strip), lambda p: p != "")
    head = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), question_label)
    return F.when(F.size(parts) >= 2, F.array_join(head, " > "))


def label_for(field: Column, labels: dict, unknown: str = presets.UNKNOWN_AREA) -> Column:
    """Label of the whole path, else of its first part, else that part itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    root = F.substring_index(field, ".", 1)
    return F.coalesce(
        F.try_element_at(table, field), F.try_element_at(table, root), truthy(root), F.lit(unknown)
    )


def route_section(label: Column, routes=presets.SECTION_ROUTES, default: str = presets.SECTION_DEFAULT) -> Column:
    """First section one of whose keywords occurs in the label."""
    lowered = F.lower(label)
    choice = None
    for section, keywords in routes:
        hit = contains_any(lowered, keywords)
        choice = F.when(hit, F.lit(section)) if choice is None else choice.when(hit, F.lit(section))
    return choice.otherwise(F.lit(default))
