"""Language identification by rank-order profiles.

A profile is the ranking of the most frequent 1- to 3-grams of a language's letters, with a space for each run of
anything else. A document's own ranking is compared with each profile: an n-gram counts as many places as its two
ranks differ, or the profile's length if the profile lacks it. The language of the smallest sum is predicted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.chars import code_points, folded, grams
from driftmark.llm.work import bound_batches, give_back

UNKNOWN = "und"
SIZES = (1, 2, 3)  # of n-grams
PROFILE = 400  # n-grams of a language
RANKED = 300  # n-grams of a document
SAMPLE = 2000  # labelled documents per language that profiles are learned from, about


@dataclass
class Profiles:
    langs: list[str]
    keys: np.ndarray  # sorted n-gram keys
    ranks: np.ndarray  # rank of each key (row) in each language (column); PROFILE where it is absent


def letter_runs(text: str) -> np.ndarray:
    """Lower-case letters of text, one space for each run of others, and one at either end; empty without letters."""
    points = folded(code_points(text), digits=False)
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    return points if len(points) > 1 else points[:0]


def counted(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams, and how often each occurs."""
    keys = np.sort(np.concatenate([grams(runs, n) for n in SIZES]))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def ranked(runs: np.ndarray, n: int = RANKED) -> np.ndarray:
    """Keys of the n most frequent n-grams, the most frequent first; of equal ones the smaller key."""
    keys, counts = counted(runs)
    return keys[np.argsort(-counts, kind="stable")[:n]]


def predict(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Language and score: one minus the mean distance per n-gram as a share of the profile's length."""
    runs = letter_runs(text or "")
    if not len(runs) or not profiles.langs:
        return UNKNOWN, 0.0
    keys = ranked(runs)
    at = np.minimum(np.searchsorted(profiles.keys, keys), len(profiles.keys) - 1)
    there = profiles.keys[at] == keys
    ranks = np.where(there[:, None], profiles.ranks[at], PROFILE)
    places = np.where(ranks < PROFILE, np.abs(ranks - np.arange(len(keys))[:, None]), PROFILE)
    mean = places.mean(0) / PROFILE
    best = int(mean.argmin())
    return profiles.langs[best], float(1 - mean[best])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's documents, merged whenever many have gathered."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            parts = held.setdefault(lang, [])
            parts.append(counted(letter_runs(text.as_py())))
            if len(parts) > 64:
                held[lang] = [merged(parts)]
    for lang, parts in held.items():
        keys, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "key", "n"])
    give_back()


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages in labelled (doc_id, text, lang); rows without text or lang teach nothing.

    About sample rows of each language are used, chosen by a hash of doc_id. What comes to the driver is a row count
    per language and the PROFILE first n-grams of each.
    """
    known = labelled.filter("text is not null and lang is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Profiles([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, sample / counts[lang]))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    total = chosen.select("text", "lang").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    rows = total.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < PROFILE).collect()
    keys = np.unique(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    ranks = np.full((len(keys), len(langs)), PROFILE)
    for r in rows:
        ranks[np.searchsorted(keys, np.int64(r["key"]).view(np.uint64)), langs.index(r["lang"])] = r["rank"]
    return Profiles(langs, keys, ranks)


def _predict(batches: Iterable[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [predict(t.as_py(), profiles) for t in batch.column("__text")]
        columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"]
        names = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])
    give_back()


def predicted(docs: DataFrame, profiles: Profiles, *keep: Column | str) -> DataFrame:
    """The kept columns of docs with lang_pred and score (0 to 1) of each row's whole text.

    A text that is null, empty or without a letter is "und" with score 0, and so is every text if no language was
    learned. Each row is judged alone, so repeated rows get the same answer; an empty table gives no rows.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(partial(_predict, profiles=profiles), f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; rows without doc_id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _accept(batches: Iterable[pa.RecordBatch], profiles: Profiles, least_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [predict(t, profiles) for t in batch.column("text").cast(pa.string()).to_pylist()]
        yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))
    give_back()


def accepted(docs: DataFrame, least_score: float) -> DataFrame:
    """docs without the rows whose language can't be told: no letter, or a score under least_score.

    Profiles are learned from docs' own lang values; if there are none, all rows stay. All columns are kept.
    """
    bound_batches(docs.sparkSession)
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))))
    return docs.mapInArrow(partial(_accept, profiles=profiles, least_score=least_score), docs.schema) if profiles.langs else docs
