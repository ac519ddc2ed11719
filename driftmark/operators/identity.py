"""Who a record is: identity, display name, and one row per identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.functions.text import truthy
from driftmark.presets import DEFAULT, UNNAMED, Profile


def truthy_text(doc: Column) -> Column:
    """Text of a document value that counts as present: not null, false, 0, empty."""
    kind, text = F.schema_of_variant(doc), doc.try_cast("string")
    absent = (
        F.when(kind == "STRING", text == "")
        .when(kind == "BOOLEAN", ~doc.try_cast("boolean"))
        .when(F.startswith(kind, F.lit("ARRAY")), F.size(V.as_list(doc)) == 0)
        .when(F.startswith(kind, F.lit("OBJECT")), F.size(F.map_keys(V.as_object(doc))) == 0)
        .otherwise(F.coalesce(doc.try_cast("double") == 0, F.lit(False)))
    )
    return F.when(~V.is_blank(doc) & ~F.coalesce(absent, F.lit(True)), F.coalesce(text, V.canonical(doc)))


def identity_of(doc: Column, fallback: Column, profile: Profile = DEFAULT) -> Column:
    """First present identity member of a document, else the fallback."""
    return F.coalesce(*[truthy_text(V.member(doc, k)) for k in profile.identity_keys], fallback)


def position_fallback(position: Column) -> Column:
    return F.concat(F.lit("position-"), position.cast("string"))


def name_of(doc: Column, profile: Profile = DEFAULT) -> Column:
    return F.coalesce(*[truthy_text(V.member(doc, k)) for k in profile.name_keys], F.lit(UNNAMED))


def flat_identity(columns: Sequence[Column], fallback: Column) -> Column:
    """Identity over plain columns, in order of preference."""
    return F.coalesce(*[truthy(c.cast("string")) for c in columns], fallback)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order.

    An aggregate, not a window: copies of one key are reduced before the shuffle.  Its output is
    already distributed by the key, so a following join on the key adds no exchange.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, "__last.*")
