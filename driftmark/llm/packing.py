"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic.

Every example is a vector of three demands: tokens, segments (one) and loss-bearing tokens. A sequence has
a limit for each. Whole sequences are cut off long examples at once; the rests wait in a pool, and a
sequence is filled by the waiting rest with the largest dot product of its demands and the room left, both
as shares of the limits. Room that no waiting rest fits into is filled by cutting one, unless it is small.

Each partition of the input packs its own rows, so nothing is shuffled, a lost task packs the same rows
again, and the memory held is the pool. What a partition has left at its end goes into sequences of powers
of two, so that little is padded there either.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tokens import END_ID, encoded_texts, encoder
from driftmark.llm.work import bound_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence. tokens must be a power of two."""

    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096
    pool: int = 512  # examples that wait at a time
    least_cut: int = 64  # room below this is padded rather than filled by cutting an example
    least_sequence: int = 64  # shortest power of two a sequence is padded to


@dataclass
class Piece:
    doc_id: int | None
    ids: np.ndarray
    free: int  # leading ids that bear no loss
    start: int
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.ids[:n], min(self.free, n), self.start, self.doc_tokens),
            Piece(self.doc_id, self.ids[n:], max(self.free - n, 0), self.start + n, self.doc_tokens),
        )

    @property
    def loss(self) -> int:
        return len(self.ids) - self.free

    def most(self, tokens: int, loss: int) -> int:
        """How many of the first ids stay within both numbers."""
        return min(tokens, len(self.ids), self.free + loss)


class Packer:
    """Takes pieces one by one and gives filled sequences to emit(list of pieces)."""

    def __init__(self, limits: Limits, emit: Callable[[list[Piece]], None]):
        self.limits, self.emit, self.waiting = limits, emit, []

    def add(self, piece: Piece) -> None:
        limits = self.limits
        while len(piece.ids) >= limits.tokens or piece.loss > limits.loss_tokens:
            n = piece.most(limits.tokens, limits.loss_tokens)
            if n < 1:
                raise ValueError("a sequence must have room for one loss-bearing token")
            full, piece = piece.cut(n)
            self.emit([full])
        if len(piece.ids):
            piece.ids = piece.ids.copy()  # a view would keep the whole slice's ids while it waits
            self.waiting.append(piece)
        if len(self.waiting) >= limits.pool:
            self._fill(limits.tokens)

    def finish(self) -> None:
        while self.waiting:
            left = sum(len(p.ids) for p in self.waiting)
            tokens = self.limits.tokens
            while tokens > max(left, self.limits.least_sequence):
                tokens //= 2
            self._fill(tokens)

    def _fill(self, tokens: int) -> None:
        limits = self.limits
        most = np.array([tokens, limits.segments, limits.loss_tokens], float)
        demand = np.array([(len(p.ids), 1, p.loss) for p in self.waiting], float)
        open_ = np.ones(len(demand), bool)
        room, chosen = most.copy(), []
        while open_.any():
            fits = open_ & (demand <= room).all(1)
            if not fits.any():
                break
            score = np.where(fits, (demand / most) @ (room / most), -1.0)
            best = int(score.argmax())
            open_[best] = False
            room -= demand[best]
            chosen.append(self.waiting[best])
        rest = [p for p, o in zip(self.waiting, open_) if o]
        if rest and room[1] >= 1 and room[0] >= min(limits.least_cut, tokens // 2):
            sizes = [p.most(int(room[0]), int(room[2])) for p in rest]
            best = int(np.argmax(sizes))
            if sizes[best]:
                part, rest[best] = rest[best].cut(sizes[best])
                chosen.append(part)
        self.waiting = rest
        self.emit(chosen)


def _pack(batches: Iterable[pa.RecordBatch], limits: Limits, path: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    base, done, rows = TaskContext.get().partitionId() << 36, 0, []

    def emit(pieces: list[Piece]) -> None:
        nonlocal done
        offset = 0
        for p in pieces:
            row = (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4")), p.doc_tokens, base + done, offset, p.loss)
            rows.append((*row, p.ids) if with_ids else row)
            offset += len(p.ids)
        done += 1

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[: len(names)]]
            if with_ids:
                names.append("ids")
                columns.append(pa.array([r[-1].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            rows.clear()
            yield pa.RecordBatch.from_arrays(columns, names)

    packer = Packer(limits, emit)
    for batch, arrays in encoded_texts(batches, path):
        prompts = batch.column("prompt").to_pylist() if "prompt" in batch.schema.names else [None] * len(arrays)
        for doc_id, ids, prompt in zip(batch.column("doc_id").to_pylist(), arrays, prompts):
            asked = encoder(path).encode(pa.array([prompt], pa.string()))[0] if prompt else ids[:0]
            ids = np.concatenate([asked, ids]) if len(asked) else ids
            packer.add(Piece(doc_id, ids, len(asked), 0, len(ids)))
        yield from flush()
    packer.finish()
    yield from flush()


def pack(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, prompt: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of an example: which sequence it lies in, and where.

    docs has doc_id and text; prompt may name a column whose ids come before those of the text and bear no
    loss. Each example ends with id 2. Null texts and prompts are empty, so an empty example is its end id
    alone; null and repeated doc_ids are packed like any other; other columns are not read; an empty table
    gives no rows. with_ids adds the ids themselves.
    """
    bound_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if prompt:
        columns.append(F.col(prompt).cast("string").alias("prompt"))
    return docs.select(*columns).mapInArrow(partial(_pack, limits=limits, path=path, with_ids=with_ids), SCHEMA + ", ids array<int>" * with_ids)
