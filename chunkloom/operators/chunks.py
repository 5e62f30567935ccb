"""Chunk tables: building, replacing, listing and sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T
from chunkloom.operators.ranking import last_per_key, ordered_index, top_n

CHUNK_ID_STRIDE = 1_000_000


def chunk_documents(
    documents: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, text) to (doc_id, chunk_index, content, tokens_est), with the columns ``keep``. No shuffle: the index comes from the array."""
    T.check_chunking(size, overlap)
    normal = documents.select("doc_id", *keep, T.normalize_document_text(F.col("text")).alias("_t"))
    pieces = normal.select("doc_id", *keep, F.posexplode(T.chunk_array(F.col("_t"), size, overlap)))
    return pieces.select(
        "doc_id",
        *keep,
        F.col("pos").alias("chunk_index"),
        F.col("col").alias("content"),
        T.estimate_tokens(F.col("col")).alias("tokens_est"),
    )


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """Stable ids that do not depend on the order of insertion."""
    return chunks.withColumn("chunk_id", F.col("doc_id") * CHUNK_ID_STRIDE + F.col("chunk_index"))


def chunk_index_assign(pieces: DataFrame) -> DataFrame:
    """0-based index over the non-blank pieces (doc_id, pos, text) of a document."""
    kept = pieces.where(R.stripped_or_empty(F.col("text")) != "")
    return ordered_index(kept, "doc_id", "pos", "chunk_index")


def replace_document_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after re-ingest: documents in ``new`` lose all their old chunks."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def upsert_latest(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the highest version wins."""
    return last_per_key(current.unionByName(incoming, allowMissingColumns=True), [key], F.col(version))


def index_row_id(vectors: DataFrame) -> DataFrame:
    """0-based row id per document index in chunk order."""
    return ordered_index(vectors, "doc_id", "chunk_index", "row_id")


def vector_index_meta(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.max(F.size("embedding")).alias("dimension")
    )


def list_chunks(chunks: DataFrame, limit: int | None = 200) -> DataFrame:
    """Chunks of each document in order, the first ``limit`` of them or all."""
    columns = chunks.columns
    if limit is not None:
        chunks = top_n(chunks, ["doc_id"], [F.col("chunk_index")], limit).select(*columns)
    return chunks.orderBy("doc_id", "chunk_index")


def embedding_tokens_per_doc(chunks: DataFrame, price_per_1k: float = 0.0) -> DataFrame:
    total = chunks.groupBy("doc_id").agg(F.sum(F.coalesce("tokens_est", F.lit(0))).alias("embedding_tokens"))
    return total.withColumn("cost_usd", F.round(R.token_cost(F.col("embedding_tokens"), price_per_1k), 8))


def capacity_estimate(
    documents: DataFrame, dim: int = 512, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    """Per document: expected chunks, vector bytes, disk range (4 to 10 KB a chunk), multiply-adds of one search."""
    n = T.window_count(F.char_length("text").cast("long"), size, overlap)
    return documents.select("doc_id", n.alias("chunk_count")).select(
        "doc_id",
        "chunk_count",
        (F.col("chunk_count") * F.lit(4 * dim)).alias("vector_bytes"),
        (F.col("chunk_count") * F.lit(4 * 1024)).alias("disk_low_bytes"),
        (F.col("chunk_count") * F.lit(10 * 1024)).alias("disk_high_bytes"),
        (F.col("chunk_count") * F.lit(dim)).alias("multiply_adds"),
    )
