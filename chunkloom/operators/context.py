"""From raw hits to the de-duplicated, renumbered context of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T
from chunkloom.operators.ranking import first_per_key, top_n


def _first_text(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def coalesce_hit_fields(raw: DataFrame, max_chars: int = K.CONTEXT_CHUNK_CHARS) -> DataFrame:
    """Accept the alternative field names of a hit; numbers that do not parse become null."""
    present = set(raw.columns)
    pick = lambda names: [n for n in names if n in present]
    nothing = F.lit(None)
    number = lambda n: (F.nullif(F.col(n).cast("string"), F.lit("")).try_cast("double") if n in present else nothing.cast("double"))
    ids = [F.nullif(F.col(n), F.lit(0)) if n == "chunk_id" else F.col(n) for n in pick(["chunk_id", "id"])]
    indexes = [F.col(n) for n in pick(["chunk_index", "seq", "index"])]
    body = T.strip(_first_text(*pick(["content", "text", "chunk_text"])))
    return raw.select(
        "query_id",
        F.coalesce(F.nullif("rank", F.lit(0)), F.col("position")).alias("rank") if "rank" in present else F.col("position").alias("rank"),
        T.truncate_hit(body, max_chars).alias("content"),
        "doc_id",
        F.coalesce(*ids, nothing).cast("long").alias("chunk_id"),
        F.coalesce(*indexes, nothing).cast("int").alias("chunk_index"),
        number("score").alias("score"),
        number("rerank_score").alias("rerank_score"),
        (F.col("original_rank") if "original_rank" in present else nothing.cast("int")).alias("original_rank"),
    )


def cut_contents(contents: DataFrame, max_chars: int = K.CONTEXT_CHUNK_CHARS) -> DataFrame:
    """Chunk texts trimmed and cut once per chunk, so that a join of hits carries no whole texts. Cutting again changes nothing."""
    return contents.withColumn("content", T.truncate_hit(T.strip(F.coalesce("content", F.lit(""))), max_chars))


def filter_empty_hits(hits: DataFrame) -> DataFrame:
    return hits.where(R.stripped_or_empty(F.col("content")) != "")


def dedup_hits_keep_first(hits: DataFrame) -> DataFrame:
    """The same content once per query; the best rank stays."""
    return first_per_key(hits, ["query_id", "content"], F.col("rank"))


def renumber_ranks(hits: DataFrame, max_chunks: int) -> DataFrame:
    """Cut to ``max_chunks`` and number 1..n in the old order."""
    renamed = hits.withColumnRenamed("rank", "_old")
    return top_n(renamed, ["query_id"], [F.col("_old")], max_chunks).drop("_old")


def assemble_context(raw_hits: DataFrame, max_chunks: int = K.CONTEXT_TOP_K) -> DataFrame:
    hits = filter_empty_hits(coalesce_hit_fields(raw_hits))
    return renumber_ranks(dedup_hits_keep_first(hits), max_chunks)


def context_mode(
    queries: DataFrame, context: DataFrame, min_score: float = K.MIN_RETRIEVAL_SCORE, score: str = "score"
) -> DataFrame:
    """Mode per query; queries without any hit stay in. The vector score decides, also after reranking."""
    top = context.where(F.col("rank") == 1).select("query_id", F.col(score).alias("_top"), F.lit(True).alias("_has"))
    mode = (
        F.when(F.col("_has").isNull(), F.lit("no_context"))
        .when(F.col("_top") < F.lit(float(min_score)), F.lit("low_confidence"))
        .otherwise(F.lit("normal"))
    )
    return queries.join(top, "query_id", "left").withColumn("mode", mode).drop("_top", "_has")
