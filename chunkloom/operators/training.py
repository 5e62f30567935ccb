"""Data for fine-tuning a retriever: BM25 candidates, hard negatives, triplets and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom import constants as K
from chunkloom.functions import text as T
from chunkloom.operators.ranking import one_row, top_n
from chunkloom.session import written

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case words; a blank text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"{T.WS}+"), lambda w: w != "")


def bm25_scores(queries: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk of the query's document that shares a term with it.

    ``queries`` has query_id, doc_id, question; ``corpus`` has chunk_id, doc_id, content. Statistics are those of the whole
    corpus. Terms meet by an equi join on (document, term) and are summed before and after the shuffle; no pair
    without a common term is ever a row.
    """
    postings, df = _postings(corpus, k1, b)
    # Weights are looked up for asked terms only, then travel with them to the chunks.
    weighted = _asked(queries).join(df, "term")
    met = weighted.join(postings, ["doc_id", "term"])
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("gain")), 6).alias("score"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "doc_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))


def _postings(corpus: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, chunk_id, gain) of all chunks, and (term, weight)."""
    words = corpus.select("chunk_id", "doc_id", terms(F.col("content")).alias("words"))
    # Repeated terms are counted where the chunk lies, so a common word is one row per chunk.
    spread = words.select("chunk_id", "doc_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    counted = spread.groupBy("doc_id", "term", "chunk_id", "length").agg(F.count("*").alias("tf"))
    totals = words.agg(F.count("*").alias("chunks"), F.avg(F.size("words").cast("double")).alias("average")).head()
    chunks, average = float(totals["chunks"]), totals["average"] or 1.0
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(F.lit(1.0) + (F.lit(chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(average)))
    return counted.select("doc_id", "term", "chunk_id", gain.alias("gain")), df.select("term", weight.alias("weight"))


def bm25_best(queries: DataFrame, corpus: DataFrame, n: int, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """The same ``n`` chunks as :func:`best_candidates` of :func:`bm25_scores`, without scoring those that cannot be among them.

    With the postings of a (document, term) goes the most that any of them adds to a score, and its ``n`` best ones. The
    best postings of a query's terms give a score that its n-th chunk has at least. Terms that cannot reach it all together bring
    no chunk in: only chunks with another term are met, and of those only the ones that could still reach it get the postings of the rest.
    The second table has one row: ``postings`` that the queries' terms have, and ``scored``, those that were read for a score.
    """
    postings, weights = _postings(corpus, k1, b)
    impact = (F.col("weight") * F.col("gain")).alias("impact")
    postings = written(postings.join(weights, "term").select("doc_id", "term", "chunk_id", impact), "postings")
    bounds = postings.groupBy("doc_id", "term").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("size"))
    champions = top_n(postings, ["doc_id", "term"], [F.desc("impact"), F.asc("chunk_id")], n).drop("rank")
    asked = written(_asked(queries).join(bounds, ["doc_id", "term"]), "asked-terms")
    parts = asked.join(champions, ["doc_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum("impact").alias("part"))
    # Scores are ranked after rounding, so a chunk within a rounding step of the floor stays in.
    floors = top_n(parts, ["query_id"], [F.desc("part"), F.asc("chunk_id")], n).groupBy("query_id")
    floors = floors.agg(F.when(F.count(F.lit(1)) == n, F.min("part") - 2e-6).alias("floor"))
    order = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = asked.join(floors, "query_id", "left").withColumn("_sum", F.sum("most").over(order))
    split = written(split.withColumn("enters", F.coalesce(F.col("_sum") >= F.col("floor"), F.lit(True))), "split-terms")
    rest = split.where(~F.col("enters"))
    met = split.where("enters").join(postings, ["doc_id", "term"])
    met = met.groupBy("query_id", "doc_id", "chunk_id", "floor").agg(F.sum("impact").alias("part"))
    left = rest.groupBy("query_id").agg(F.sum("most").alias("left"))
    met = met.join(left, "query_id", "left").where(F.col("floor").isNull() | (F.col("part") + F.coalesce("left", F.lit(0.0)) >= F.col("floor")))
    met = written(met, "met-chunks")
    more = met.select("query_id", "doc_id", "chunk_id").join(rest.select("query_id", "doc_id", "term"), ["query_id", "doc_id"])
    more = written(more.join(postings, ["doc_id", "term", "chunk_id"]).select("query_id", "chunk_id", "impact"), "more-postings")
    score = F.round(F.sum("part"), 6).alias("score")
    scores = met.select("query_id", "chunk_id", "part").union(more).groupBy("query_id", "chunk_id").agg(score)
    whole = split.agg(F.sum("size").alias("postings"), F.sum(F.when(F.col("enters"), F.col("size"))).alias("scored"))
    report = one_row(whole, more.agg(F.count(F.lit(1)).alias("later")))
    return best_candidates(scores, n), report.select("postings", (F.coalesce("scored", F.lit(0)) + F.col("later")).alias("scored"))


def best_candidates(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` best chunks of each query as weakly supervised positives; ties go to the lower chunk id."""
    return top_n(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], n)


def hard_negatives(scores: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The ``n`` best chunks of each query that ``labels`` (query_id, chunk_id) does not name. Scores may be of any retriever."""
    unlabelled = scores.join(labels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    return top_n(unlabelled, ["query_id"], [F.desc("score"), F.asc("chunk_id")], n)


def build_triplets(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, positive_id, negative_id): each positive with each negative of its query, never a chunk with itself.

    Both sides hold a fixed few rows per query, so this is no pair join of groups that grow.
    """
    p = positives.select("query_id", F.col("chunk_id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = negatives.select("query_id", F.col("chunk_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return p.join(n, "query_id").where("positive_id <> negative_id")


def triplet_metrics(triplets: DataFrame) -> DataFrame:
    """One row: number, accuracy, mean and standard deviation of the margin, mean scores; six digits."""
    margin = F.col("positive_score") - F.col("negative_score")
    six = lambda c, name: F.round(c, 6).alias(name)
    return triplets.agg(
        F.count("*").alias("triplets"),
        six(F.avg((margin > 0).cast("double")), "accuracy"),
        six(F.avg(margin), "mean_margin"),
        six(F.stddev_pop(margin), "std_margin"),
        six(F.avg("positive_score"), "mean_positive_score"),
        six(F.avg("negative_score"), "mean_negative_score"),
    )


def fused_score(scored: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """alpha * vector score scaled to 0..1 among the query's candidates + beta * rerank score, six digits; 1 where all scores are equal.

    The windows span the candidates of one query (30 by default).
    """
    query = Window.partitionBy("query_id")
    low, high = F.min("score").over(query), F.max("score").over(query)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return scored.withColumn("fused_score", F.round(F.round(alpha * scaled + beta * F.coalesce("rerank_score", F.lit(0.0)), 12), 6))


def low_rerank_threshold(queries: DataFrame, ranked: DataFrame, least: float = K.MIN_RETRIEVAL_SCORE) -> DataFrame:
    """Per query: hits at or above the threshold, and the mode that follows (normal, low_confidence, no_context)."""
    kept = ranked.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(F.col("rerank_score") >= F.lit(float(least))).alias("kept"))
    mode = F.when(F.col("hits").isNull(), F.lit("no_context")).when(F.col("kept") == 0, F.lit("low_confidence")).otherwise(F.lit("normal"))
    return queries.select("query_id").join(kept, "query_id", "left").select("query_id", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), mode.alias("mode"))


def merge_adjacent_hits(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Hits widened by ``reach`` chunks on each side and merged where they touch: (query_id, doc_id, first_index, last_index, chunks).

    ``hits`` has query_id, doc_id, chunk_index, a few rows per query; ``chunks`` says which indexes exist.
    """
    near = F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach))
    wide = hits.select("query_id", "doc_id", near.alias("chunk_index")).distinct()
    there = wide.join(chunks.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"], "left_semi")
    order = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index")
    island = F.col("chunk_index") - F.row_number().over(order)
    runs = there.withColumn("_island", island).groupBy("query_id", "doc_id", "_island")
    return runs.agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("chunks")).drop("_island")
