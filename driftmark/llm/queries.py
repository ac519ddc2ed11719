"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import (
    conversation_trie,
    decontaminate,
    exact_dedup,
    langid,
    line_dedup,
    merges,
    oracles,
    packing,
    part_codes,
    pii,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)
from driftmark.llm.work import bound_batches, stored

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    return token_files.token_files(_table(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    docs = _table(spark, folder, "documents")
    return pii.personal_data(docs, pii.learn(docs))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = _table(spark, folder, "documents")
    profiles = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predicted(docs, profiles, "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items with a passage in a document, for all documents."""
    return decontaminate.passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of those that are not held out."""
    docs = _table(spark, folder, "documents")
    model = toxicity.learn(toxicity.teachable(docs), toxicity.teachable(_table(spark, folder, "labels")))
    return toxicity.scored(docs, model, "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that each document loses to earlier documents or lines, and what is left of its text."""
    found = line_dedup.drop_repeated_lines(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_equal", "n_near", F.sha2("text", 256).alias("text_sha256"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, folder, "documents"))


def op9_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that lie in a string of 200 bytes found elsewhere."""
    return suffix_dedup.drop_repeated_bytes(_table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_groups(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared heads."""
    return conversation_trie.rebuilt_trie(_table(spark, folder, "conversations"))


def op12_merges(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded again."""
    found = merges.decoded(merges.encoded(_table(spark, folder, "documents")))
    n_tokens = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return found.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_part_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors with codebooks learned from all of them."""
    kept = part_codes.integer_vectors(_table(spark, folder, "embeddings"))
    books = part_codes.learn(kept)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    found = part_codes.with_label_errors(stored(part_codes.coded(kept, books), "part-codes"))
    digest = F.lit(hashlib.sha256(part_codes.books_text(books).encode()).hexdigest())
    return found.select("vec_id", part_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_suffix_array": op9_suffix_array,
    "op10_simhash": op10_simhash,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merges": op12_merges,
    "op13_part_codes": op13_part_codes,
}

ORACLES: dict[str, str] = {
    "op11_conversation_trie": oracles.CONVERSATION_TRIE,
    "op13_part_codes": oracles.part_codes(),
    "op2_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(length(text), 0) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (
            SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
                first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
            FROM n
        )
    """,
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, line_no, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS flat
            FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
                FROM documents WHERE text IS NOT NULL
            )
        ),
        first_of AS (SELECT flat, min((doc_id, line_no)) AS place, string_split(flat, ' ') AS words FROM lines WHERE flat <> '' GROUP BY flat),
        long_ones AS (SELECT flat, place, words, len(words) AS n FROM first_of WHERE len(words) >= 5),
        variants AS (
            SELECT place, n, pos, array_to_string(words[1 : pos - 1] || words[pos + 1 :], ' ') AS rest
            FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM long_ones)
        ),
        near AS (
            SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY rest, pos, n) AS first FROM variants) WHERE first < place
            UNION
            SELECT greatest(v.place, l.place) FROM variants v JOIN long_ones l ON v.rest = l.flat
        ),
        judged AS (
            SELECT l.doc_id, l.line_no, l.line, l.flat <> '' AND f.place < (l.doc_id, l.line_no) AS equal, l.flat <> '' AND f.place = (l.doc_id, l.line_no) AND n.place IS NOT NULL AS near
            FROM lines l LEFT JOIN first_of f ON f.flat = l.flat LEFT JOIN near n ON n.place = f.place
        )
        SELECT doc_id, sum(coalesce(equal, false)::int)::bigint AS n_equal, sum(coalesce(near, false)::int)::bigint AS n_near,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(equal, false) AND NOT coalesce(near, false)), '')) AS text_sha256
        FROM judged GROUP BY doc_id
    """,
}
