"""Token-id files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

A file holds whole documents in ascending order of doc_id. Its ids are replaced by their rank among the
file's own ids, the most frequent first, so that each file can be decoded alone and no second pass over the
corpus is needed. A rank takes 1 to 4 bytes; four lengths are kept in one control byte, apart from the rank
bytes. Decoding looks the lengths of a control byte up in a table of 256 rows and gathers all ranks at once.

Layout, little-endian: magic, then int64 n_docs, n_ids, n_ranks, n_data; uint32 id of each rank; int64 doc_id and
uint8 "doc_id is not null" and int64 length of each document; control bytes; rank bytes; uint32 CRC-32 of all
before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.llm.tokens import encoded_texts
from driftmark.llm.work import bound_batches
from driftmark.session import new_work_dir

MAGIC = b"DMIDS001"
TOKENS_PER_FILE = 2_000_000
AT_ONCE = 1 << 18  # ids coded or decoded at once, a multiple of four
MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Bytes of each of the four ranks of a control byte.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and rank bytes of uint32 ranks."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = size
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks that pack_ranks coded."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for byte in range(1, int(size.max()) if n else 0):
        longer = np.flatnonzero(size > byte)
        ranks[longer] |= data[at[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file's content for documents in order."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    pieces = [flat[i : i + AT_ONCE] for i in range(0, len(flat), AT_ONCE)]
    counts = np.zeros(int(flat.max()) + 1 if len(flat) else 0, np.int64)
    for piece in pieces:
        counts += np.bincount(piece, minlength=len(counts))
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table))
    coded = [pack_ranks(rank[piece]) for piece in pieces]
    control, data = b"".join(c.tobytes() for c, _ in coded), b"".join(d.tobytes() for _, d in coded)
    parts = [
        MAGIC,
        np.array([len(doc_ids), len(flat), len(table), len(data)], "<i8"),
        table.astype("<u4"),
        np.array([x or 0 for x in doc_ids], "<i8"),
        np.array([x is not None for x in doc_ids], np.uint8),
        np.array([len(x) for x in ids], "<i8"),
        control,
        data,
    ]
    body = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def file_documents(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and id arrays of a file's documents; a damaged file is an error."""
    if content[:8] != MAGIC or zlib.crc32(memoryview(content)[:-4]) != int.from_bytes(content[-4:], "little"):
        raise ValueError("not a whole token-id file")
    n_docs, n_ids, n_ranks, n_data = (int(x) for x in np.frombuffer(content, "<i8", 4, 8))
    at = 40

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, n, at)
        at += found.nbytes
        return found

    table, doc_ids, present, lengths = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    ids, begin = np.empty(n_ids, np.uint32), 0
    for i in range(0, n_ids, AT_ONCE):
        n = min(AT_ONCE, n_ids - i)
        some = control[i // 4 : -(-(i + n) // 4)]
        ids[i : i + n] = table[unpack_ranks(some, data[begin:], n)]
        begin += int(LENGTHS[some].reshape(-1)[:n].sum())
    return [int(x) if p else None for x, p in zip(doc_ids, present)], np.split(ids, np.cumsum(lengths)[:-1]) if n_docs else []


def _write(batches: Iterable[pa.RecordBatch], folder: str, path: str | None, tokens_per_file: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    doc_ids, ids, held, n = [], [], 0, 0

    def put() -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        if doc_ids:
            # The name is this attempt's own: only the files of attempts that end well are in the manifest.
            name = f"ids-{task.partitionId():05d}-{n:05d}-{task.taskAttemptId()}.bin"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(doc_ids, ids))
            row = [task.partitionId(), n, name, len(doc_ids), held]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "file", "path", "n_docs", "n_tokens"])
            doc_ids.clear(), ids.clear()
            held, n = 0, n + 1

    for batch, arrays in encoded_texts(batches, path):
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), arrays):
            doc_ids.append(doc_id)
            ids.append(found.astype(np.uint16) if len(found) and found.max() < 1 << 16 else found)
            held += len(found)
            if held >= tokens_per_file:
                yield from put()
    yield from put()


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, tokens_per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Write the ids of docs (doc_id, text) to folder, which driver and executors share; the manifest of its files.

    Null texts are empty; each document ends with id 2. Null doc_ids come first; rows of the same doc_id are all
    written, in order of text. Other columns are not read. An empty table gives a manifest without rows.
    """
    bound_batches(docs.sparkSession)
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write = partial(_write, folder=folder, path=path, tokens_per_file=tokens_per_file)
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(batches: Iterable[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            with files.open_input_stream(f"{root}/{name}") as source:
                doc_ids, ids = file_documents(source.read())
            sizes = np.array([len(x) for x in ids], np.int64)
            columns = [
                pa.array(doc_ids, pa.int64()),
                pa.array(start + np.cumsum(sizes) - sizes),
                pa.array(sizes),
                pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a folder's files, with the number of ids of all documents before it.

    Positions come from the manifest: a running total over the writing tasks (one row each), then over
    each task's own files.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    own = Window.partitionBy("part").orderBy("file")
    placed = manifest.join(before, "part").select("path", (F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("start"))
    return placed.repartition("path").mapInArrow(partial(_read, folder=folder, with_ids=with_ids), DOCUMENTS + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the token-id files of docs to folder (a new shared one by default) and read them back."""
    spark = docs.sparkSession
    folder = folder or new_work_dir(spark, "token-files")
    write_token_files(docs, folder, path)
    return read_token_files(spark, folder)
