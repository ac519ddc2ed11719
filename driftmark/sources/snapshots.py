"""The snapshot store: immutable versions as partitions, and the dimension that lists them.

Layout: ``<root>/entries/snapshot_id=...`` holds `(entity_id, doc, h64, h32)`, and
``<root>/snapshots/snapshot_id=...`` one row `(created_at, entry_count)`.  The dimension row is
written last, so a snapshot without it is not listed; writing an id again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import variant as V
from driftmark.operators import identity as I
from driftmark.presets import DEFAULT, Profile
from driftmark.sources.bundles import parse_documents, read_documents

SNAPSHOT_SCHEMA = "snapshot_id string, created_at string, entry_count bigint"


def write_snapshot(entries: DataFrame, root: str, snapshot_id: str, created_at: str) -> int:
    """Store `(entity_id, doc VARIANT)` as one version; the count comes with the write, not from a second pass."""
    text = V.canonical(F.col("doc"))
    seen = Observation()
    hashed = entries.select("entity_id", "doc", F.xxhash64(text).alias("h64"), F.hash(text).alias("h32"))
    hashed.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/entries/snapshot_id={snapshot_id}")
    count = seen.get["n"]
    spark = entries.sparkSession
    row = spark.range(1).select(F.lit(created_at).alias("created_at"), F.lit(count).cast("bigint").alias("entry_count"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/snapshots/snapshot_id={snapshot_id}")
    return count


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """`(snapshot_id, created_at, entry_count)`; empty when nothing was stored yet."""
    try:
        found = spark.read.option("basePath", f"{root}/snapshots").schema(SNAPSHOT_SCHEMA).parquet(f"{root}/snapshots")
        return found.select("snapshot_id", "created_at", "entry_count")
    except Exception as error:  # the folder does not exist before the first snapshot
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """One version `(entity_id, doc, fingerprint)`; only its partition is read."""
    rows = spark.read.parquet(f"{root}/entries/snapshot_id={snapshot_id}")
    return rows.select("entity_id", "doc", F.struct("h64", "h32").alias("fingerprint"))


def read_snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """`(snapshot_id, created_at, pos, doc)` of snapshots exported as single JSON documents.

    No `entries` gives no rows, no `created_at` reads `unknown`; `entries` that is not a list, or a
    file that is not JSON, stops the read.
    """
    return _snapshot_rows(read_documents(spark, path))


def stream_snapshot_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """The same as a stream over a folder in which snapshot files arrive."""
    text = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path, wholetext=True)
    return _snapshot_rows(parse_documents(text))


def _snapshot_rows(docs: DataFrame) -> DataFrame:
    doc = F.col("doc")
    entries = V.member(doc, "entries")
    invalid = doc.isNull() | (entries.isNotNull() & V.as_list(entries).isNull())
    checked = F.when(
        invalid, F.raise_error(F.concat(F.lit("snapshot has an invalid entries field: "), F.col("file"))).cast(V.LIST)
    ).otherwise(V.as_list(entries))
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    created = F.coalesce(V.at(doc, "created_at"), F.lit("unknown"))
    return docs.select(name.alias("snapshot_id"), created.alias("created_at"), F.posexplode(checked).alias("pos", "doc"))


def index_entries(entries: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """`(snapshot_id, entity_id, doc)`: identity of every entry, the last entry of an identity wins."""
    identity = I.identity_of(F.col("doc"), I.position_fallback(F.col("pos")), profile)
    named = entries.select("snapshot_id", identity.alias("entity_id"), "pos", "doc")
    return I.latest_per_key(named, ["snapshot_id", "entity_id"], ["pos"]).drop("pos")
