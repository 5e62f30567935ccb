"""Retrieval quality against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

DIGITS = 6


def label_set(labels: DataFrame) -> DataFrame:
    """Distinct non-null (query_id, label_kind, value); kind is ``id`` or ``index``."""
    return labels.where(F.col("value").isNotNull()).select("query_id", "label_kind", "value").distinct()


def hits_vs_labels(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits with ``relevant``: chunk id among the id labels or chunk index among the index labels."""
    wanted = label_set(labels)

    def of_kind(kind: str, column: str, flag: str) -> DataFrame:
        return wanted.where(F.col("label_kind") == kind).select(
            "query_id", F.col("value").alias(column), F.lit(True).alias(flag)
        )

    by_id = of_kind("id", "chunk_id", "_by_id")
    by_index = of_kind("index", "chunk_index", "_by_index")
    return (
        hits.join(by_id, ["query_id", "chunk_id"], "left")
        .join(by_index, ["query_id", "chunk_index"], "left")
        .withColumn("relevant", F.coalesce("_by_id", "_by_index", F.lit(False)))
        .drop("_by_id", "_by_index")
    )


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank.cast("double") + 1)


def ideal_gain(n: Column) -> Column:
    ranks = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    total = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r.cast("double") + 1))
    return F.when(n > 0, total)


def first_relevant_rank(marked: DataFrame) -> DataFrame:
    """Rank of the first relevant hit and its reciprocal (0 without one)."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return marked.groupBy("query_id").agg(
        first.alias("first_rank"), F.coalesce(F.round(1.0 / first, DIGITS), F.lit(0.0)).alias("reciprocal_rank")
    )


def relevant_counts(labels: DataFrame) -> DataFrame:
    return label_set(labels).groupBy("query_id").agg(F.count("*").alias("relevant_count"))


def _metrics(marked: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures per ``keys`` for every row of ``base``; labelled queries without hits stay in."""
    per_query = marked.groupBy(*keys).agg(
        F.count("rank").alias("_hits"),
        F.count_if("relevant").alias("_matched"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"),
        F.sum(F.when(F.col("relevant"), discount(F.col("rank")))).alias("_dcg"),
    )
    joined = base.join(per_query, [*keys], "left")
    hits = F.coalesce("_hits", F.lit(0))
    matched = F.coalesce("_matched", F.lit(0))
    ideal = ideal_gain(F.least(F.col("relevant_count"), hits))
    return joined.select(
        *keys,
        "relevant_count",
        matched.alias("relevant_hit_count"),
        F.round(matched / F.col("relevant_count"), DIGITS).alias("recall_at_k"),
        F.coalesce(F.round(1.0 / F.col("_first"), DIGITS), F.lit(0.0)).alias("mrr"),
        F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, DIGITS).alias("ndcg"),
    )


def retrieval_eval(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall, reciprocal rank and NDCG per labelled query; the ideal uses the hits returned, not k."""
    return _metrics(hits_vs_labels(hits, labels), relevant_counts(labels), ["query_id"])


def metrics_at_k_grid(hits: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Means over the labelled queries at several cut-offs of one ranking."""
    cutoffs = F.explode(F.array(*[F.lit(k) for k in ks]))
    cut = hits_vs_labels(hits, labels).withColumn("k", cutoffs).where(F.col("rank") <= F.col("k"))
    base = relevant_counts(labels).withColumn("k", cutoffs)
    return _metrics(cut, base, ["query_id", "k"]).groupBy("k").agg(
        F.count("*").alias("queries"),
        F.round(F.avg("recall_at_k"), 4).alias("recall"),
        F.round(F.avg("mrr"), 4).alias("mrr"),
        F.round(F.avg("ndcg"), 4).alias("ndcg"),
    )


def macro_columns() -> list[Column]:
    """Aggregates of recall_at_k, mrr and ndcg; the sample count is the first non-zero of the three counts."""
    names = ("recall_at_k", "mrr", "ndcg")
    counts = [F.nullif(F.count(c), F.lit(0)) for c in names]
    return [F.coalesce(*counts, F.lit(0)).alias("retrieval_eval_samples"), *[F.round(F.avg(c), 4).alias(f"{c}_avg") for c in names]]


def retrieval_eval_macro(per_query: DataFrame) -> DataFrame:
    """Averages in one row."""
    return per_query.agg(*macro_columns())
