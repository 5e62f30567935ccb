"""Exact inner-product search, candidate reranking and rank bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom import constants as K
from chunkloom.operators.ranking import ordered_index, top_n

SCORE_DIGITS = 6
VECTOR_BLOCK = 1024
QUERY_BLOCK = 256
#: Bytes of query vectors that are broadcast at most.
BROADCAST_QUERY_BYTES = 64 << 20
SALTS = 32

SCORED = "query_id long, doc_id long, chunk_id long, chunk_index long, raw double"


def validate_topk(k: Column, low: int = 1, high: int | None = None) -> Column:
    """Missing or small values rise to ``low``; ``high`` caps where an endpoint has a maximum."""
    value = F.greatest(F.lit(low), F.coalesce(F.nullif(k, F.lit(0)), F.lit(1)))
    return F.least(F.lit(high), value) if high is not None else value


def candidate_count(k: int, configured: int = K.CANDIDATE_TOP_K, rerank: bool = True) -> int:
    return max(k, configured) if rerank else k


def guard_index_usable(requests: DataFrame, index_meta: DataFrame, model: str) -> DataFrame:
    """Requests with ``usable`` and the reason why not."""
    meta = index_meta.select("doc_id", F.col("status").alias("_status"), F.col("embedding_model").alias("_model"))
    reason = (
        F.when(F.col("_status").isNull(), F.lit("not_found"))
        .when(F.col("_status") != "READY", F.lit("not_ready"))
        .when(~F.col("_model").eqNullSafe(F.lit(model)), F.lit("model_mismatch"))
    )
    return (
        requests.join(meta, "doc_id", "left")
        .withColumn("reject_reason", reason)
        .withColumn("usable", F.col("reject_reason").isNull())
        .drop("_status", "_model")
    )


def vector_blocks(vectors: DataFrame, size: int = VECTOR_BLOCK) -> DataFrame:
    """At most ``size`` vectors of one document per row, as flat arrays."""
    block = F.floor(F.col("chunk_index") / F.lit(size)).cast("long")
    item = F.struct(F.col("chunk_id").cast("long").alias("id"), F.col("chunk_index").cast("long").alias("ix"), "embedding")
    return (
        vectors.groupBy("doc_id", block.alias("block"))
        .agg(F.collect_list(item).alias("v"))
        .select(
            "doc_id",
            "block",
            F.transform("v", lambda x: x["id"]).alias("chunk_ids"),
            F.transform("v", lambda x: x["ix"]).alias("chunk_indexes"),
            F.flatten(F.transform("v", lambda x: x["embedding"])).alias("matrix"),
        )
    )


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK, few: bool = False) -> DataFrame:
    """At most ``size`` queries of one document per row, and full rows where there are many.

    Query ids may be sparse, so they are numbered per document first; ``few`` says that all
    queries together are known to be few, which makes a plain window enough.
    """
    if few:
        order = Window.partitionBy("doc_id").orderBy("query_id")
        numbered = queries.withColumn("_at", F.row_number().over(order) - 1)
    else:
        numbered = ordered_index(queries, "doc_id", "query_id", "_at")
    block = F.floor(F.col("_at") / F.lit(size)).cast("long")
    return (
        numbered.groupBy("doc_id", block.alias("query_block"))
        .agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
        .select(
            "doc_id",
            F.transform("q", lambda x: x["query_id"]).alias("query_ids"),
            F.flatten(F.transform("q", lambda x: x["embedding"])).alias("query_matrix"),
        )
    )


def _products(batch: pa.RecordBatch):
    """Per row of a batch: its document, ids and the score matrix (queries by chunks)."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        cell = lambda name: columns[name][i].values.to_numpy(zero_copy_only=False)
        query_ids, chunk_ids = cell("query_ids"), cell("chunk_ids")
        q = cell("query_matrix").astype("float64").reshape(len(query_ids), -1)
        v = cell("matrix").astype("float64").reshape(len(chunk_ids), -1)
        yield columns["doc_id"][i].as_py(), query_ids, chunk_ids, cell("chunk_indexes"), q @ v.T


def _block_search(k: int):
    """Arrow task: one matrix product per (query block, vector block), k best and near-ties kept."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, query_ids, chunk_ids, indexes, scores in _products(batch):
                if scores.shape[1] > k:
                    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    # Ranks are decided after rounding, so everything within a rounding step stays in.
                    rows, cols = np.nonzero(scores >= kth[:, None] - 2.0 * 10.0**-SCORE_DIGITS)
                else:
                    rows, cols = np.indices(scores.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(query_ids[rows], pa.int64()),
                        pa.array(np.full(len(rows), doc), pa.int64()),
                        pa.array(chunk_ids[cols], pa.int64()),
                        pa.array(indexes[cols], pa.int64()),
                        pa.array(scores[rows, cols], pa.float64()),
                    ],
                    names=["query_id", "doc_id", "chunk_id", "chunk_index", "raw"],
                )

    return search


def _block_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, query_ids, chunk_ids, _, scores in _products(batch):
            columns = [
                pa.array(query_ids, pa.int64()),
                pa.array(np.full(len(query_ids), len(chunk_ids)), pa.int64()),
                pa.array(scores.max(axis=1), pa.float64()),
                pa.array(scores.min(axis=1), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "pairs", "best", "worst"])


def blocks_by_document(queries: DataFrame, vectors: DataFrame, broadcast_bytes: int = BROADCAST_QUERY_BYTES) -> DataFrame:
    """Blocks of vectors next to the blocks of queries of the same document.

    No (query, chunk) pair is ever a row. Query vectors of up to ``broadcast_bytes``
    together (summed up) are broadcast; beyond that both sides shuffle on (document, salt), which spreads the blocks
    of a hot document over many tasks. Arrow batches are bounded by Spark's byte limit.
    ``vectors`` may be plain rows or blocks stored at indexing time, which then do not move
    when queries are broadcast.
    """
    wanted = queries.select("query_id", "doc_id", "embedding")
    few = (wanted.agg(F.sum(F.size("embedding") * 4 + 16)).head()[0] or 0) <= broadcast_bytes
    q = query_blocks(wanted, few=few)
    v = vectors if "matrix" in vectors.columns else vector_blocks(vectors)
    if few:
        met = v.join(F.broadcast(q), "doc_id")
    else:
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = v.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(q, ["doc_id", "salt"])
    return met.select("doc_id", "query_ids", "query_matrix", "chunk_ids", "chunk_indexes", "matrix")


def score_query_vs_chunks(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query against every chunk of its document: scores compared, the best and the worst."""
    parts = blocks_by_document(queries, vectors).mapInArrow(_block_scores, "query_id long, pairs long, best double, worst double")
    return parts.groupBy("query_id").agg(
        F.sum("pairs").alias("pairs"),
        F.round(F.max("best"), SCORE_DIGITS).alias("best"),
        F.round(F.min("worst"), SCORE_DIGITS).alias("worst"),
    )


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, broadcast_bytes: int = BROADCAST_QUERY_BYTES
) -> DataFrame:
    """Exact top-k of each query inside its document; each block product hands on about k rows per query."""
    hits = blocks_by_document(queries, vectors, broadcast_bytes).mapInArrow(_block_search(k), SCORED).select(
        "query_id",
        "doc_id",
        "chunk_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.round("raw", SCORE_DIGITS).alias("score"),
    )
    order = [F.desc("score"), F.asc("chunk_index"), F.asc("chunk_id")]
    return top_n(hits, ["query_id"], order, k)


def hits_to_chunks(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Index positions to chunks; positions outside the mapping drop out."""
    return hits.where(F.col("row_id") >= 0).join(mapping, ["doc_id", "row_id"])


def keep_original_rank(hits: DataFrame, candidates: int) -> DataFrame:
    order = [F.desc("score"), F.asc("chunk_index"), F.asc("chunk_id")]
    return top_n(hits, ["query_id"], order, candidates, "original_rank")


def assign_final_rank(hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    ranked = top_n(hits, ["query_id"], order, k, "rank")
    if "vector_score" not in ranked.columns:
        ranked = ranked.withColumn("vector_score", F.col("score"))
    return ranked


def rerank_pairs(hits: DataFrame, questions: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates with their question and the text to judge: the content, else the snippet."""
    text = F.coalesce(F.nullif("content", F.lit("")), F.nullif("snippet", F.lit("")), F.lit(""))
    asked = hits.join(questions.select("query_id", "question"), "query_id")
    return asked.join(contents.select("chunk_id", text.alias("content")), "chunk_id")


def rerank_topk(scored: DataFrame, k: int) -> DataFrame:
    """Best k by (rerank score, vector score); ties keep the candidate order."""
    if k <= 0:
        return scored.withColumn("rank", F.lit(1)).where(F.lit(False))
    order = [F.desc_nulls_last("rerank_score"), F.desc_nulls_last("score"), F.asc("original_rank")]
    return assign_final_rank(scored, order, k)


def two_phase_topk(
    queries: DataFrame, vectors: DataFrame, contents: DataFrame, scorer, k: int,
    configured: int = K.CANDIDATE_TOP_K,
) -> DataFrame:
    """Vector candidates, then the scorer on those few, then the final k.

    ``contents`` is (chunk_id, content); ``scorer(candidates, queries, contents)`` adds
    ``rerank_score``. Hits carry ids only: join the text of the final k where it is needed.
    """
    hits = vector_topk(queries, vectors, candidate_count(k, configured)).withColumnRenamed("rank", "original_rank")
    return rerank_topk(scorer(hits, queries, contents), k)


def rerank_fallback(scored: DataFrame, k: int, enabled: bool = True) -> DataFrame:
    """Final hits when the scorer may have failed, with the rerank facts of their query.

    A query with any missing rerank score falls back to vector order as a whole. The windows
    span the candidates of one query.
    """
    query = Window.partitionBy("query_id")
    failed = F.bool_or(F.col("rerank_score").isNull()).over(query)
    facts = scored.withColumns({"_failed": failed, "candidate_count": F.count("*").over(query)})
    used = ~F.col("_failed") & F.lit(enabled)
    cleared = facts.withColumns({"used": used, "rerank_score": F.when(used, F.col("rerank_score"))})
    return (
        rerank_topk(cleared, k)
        .withColumns(
            {
                "original_rank": F.when(F.col("used"), F.col("original_rank")),
                "enabled": F.col("used"),
                "fallback": F.col("_failed") & F.lit(enabled),
                "provider": F.when(F.col("used"), F.lit("cross_encoder")).otherwise(F.lit("faiss")),
                "returned_count": F.least(F.col("candidate_count"), F.lit(k)).cast("long"),
            }
        )
        .drop("_failed")
    )


def rerank_meta(hits: DataFrame) -> DataFrame:
    """One row of rerank facts per query."""
    names = ["enabled", "used", "fallback", "provider", "candidate_count", "returned_count"]
    return hits.where(F.col("rank") == 1).select("query_id", *names)
