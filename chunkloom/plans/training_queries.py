"""Training data for the retriever, and the scoring options that depend on reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom import constants as K
from chunkloom.operators import embedding as M, retrieval as S, training as R
from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query
from chunkloom.session import written


def _term_list(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '{O.WS}+'), lambda w: w <> '')"


#: The chunks that a query can meet: its document's vectors with their texts.
O.cte("bm25_words", f"SELECT chunk_id, doc_id, {_term_list('content')} AS words FROM contents JOIN vectors USING (chunk_id)", "contents", "vectors")
O.cte("bm25_counts", "SELECT doc_id, chunk_id, length, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, len(words) AS length, unnest(words) AS term FROM bm25_words) GROUP BY ALL", "bm25_words")
O.cte("bm25_df", "SELECT term, count(*) AS df FROM bm25_counts GROUP BY term", "bm25_counts")
O.cte("bm25_asked", f"SELECT query_id, doc_id, unnest(list_distinct({_term_list('question')})) AS term FROM queries", "queries")
O.cte(
    "bm25_scored",
    """SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score
  FROM bm25_asked JOIN bm25_df USING (term) JOIN bm25_counts USING (doc_id, term),
    (SELECT count(*)::DOUBLE AS n, avg(len(words)::DOUBLE) AS average FROM bm25_words) GROUP BY query_id, chunk_id""",
    "bm25_asked", "bm25_df", "bm25_counts", "bm25_words",
)
O.cte("labelled_chunks", "SELECT DISTINCT q.chunk_id AS query_id, v.chunk_id FROM vectors q JOIN vectors v USING (doc_id, label)", "vectors")


def _ranked(source: str, name: str, n: int, where: str = "") -> tuple[str, str]:
    return name, f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source} {where}) WHERE rank <= {n}"


_NOT_LABELLED = "s WHERE NOT EXISTS (SELECT 1 FROM labelled_chunks l WHERE l.query_id = s.query_id AND l.chunk_id = s.chunk_id)"
O.cte(*_ranked("bm25_scored", "bm25_best", 2), "bm25_scored")
O.cte(*_ranked("bm25_scored", "bm25_hard", 3, _NOT_LABELLED), "bm25_scored", "labelled_chunks")
O.cte("top30", "SELECT query_id, chunk_id, score FROM ranked WHERE original_rank <= 30", "ranked")
O.cte(*_ranked("top30", "vector_hard", 3, _NOT_LABELLED), "top30", "labelled_chunks")
O.cte(
    "triplets",
    """SELECT p.query_id, p.chunk_id AS positive_id, n.chunk_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM bm25_best p JOIN bm25_hard n ON p.query_id = n.query_id AND p.chunk_id <> n.chunk_id""",
    "bm25_best", "bm25_hard",
)


def _corpus(spark, sf):
    return A.vectors(spark, sf).select("chunk_id", "doc_id").join(A.vector_contents(spark, sf), "chunk_id")


def _bm25(spark, sf):
    return R.bm25_scores(A.queries(spark, sf), _corpus(spark, sf))


def _labelled(spark, sf):
    v = A.vectors(spark, sf).select("doc_id", "label", "chunk_id")
    return v.withColumnRenamed("chunk_id", "query_id").join(v, ["doc_id", "label"]).select("query_id", "chunk_id")


def _ranked_rows(df):
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(O.using("bm25_scored", body="SELECT * FROM bm25_scored"))
def bm25_scores(spark, sf):
    return _bm25(spark, sf)


@query(O.using("bm25_best", body="SELECT * FROM bm25_best"))
def bm25_positives(spark, sf):
    return _ranked_rows(R.bm25_best(A.queries(spark, sf), _corpus(spark, sf), 2)[0])


@query(O.using("bm25_hard", body="SELECT * FROM bm25_hard"))
def bm25_hard_negatives(spark, sf):
    return _ranked_rows(R.hard_negatives(_bm25(spark, sf), _labelled(spark, sf), 3))


@query(O.using("vector_hard", body="SELECT * FROM vector_hard"))
def embedding_hard_negatives(spark, sf):
    hits = S.vector_topk(A.queries(spark, sf), A.vectors(spark, sf), K.CANDIDATE_TOP_K).select("query_id", "chunk_id", "score")
    return _ranked_rows(R.hard_negatives(hits, _labelled(spark, sf), 3))


def _triplets(spark, sf):
    scores = written(_bm25(spark, sf), "bm25")
    return R.build_triplets(R.best_candidates(scores, 2), R.hard_negatives(scores, _labelled(spark, sf), 3))


@query(O.using("triplets", body="SELECT * FROM triplets"))
def build_triplets(spark, sf):
    return _triplets(spark, sf)


@query(O.using("triplets", body="""SELECT count(*) AS triplets, round(avg((positive_score > negative_score)::INTEGER::DOUBLE), 6) AS accuracy,
    round(avg(positive_score - negative_score), 6) AS mean_margin, round(stddev_pop(positive_score - negative_score), 6) AS std_margin,
    round(avg(positive_score), 6) AS mean_positive_score, round(avg(negative_score), 6) AS mean_negative_score FROM triplets"""))
def triplet_metrics(spark, sf):
    return R.triplet_metrics(_triplets(spark, sf))


def _reranked_candidates(spark, sf):
    hits = S.vector_topk(A.queries(spark, sf), A.vectors(spark, sf), K.CANDIDATE_TOP_K).withColumnRenamed("rank", "original_rank")
    return M.token_overlap(hits, A.queries(spark, sf), A.vector_contents(spark, sf))


@query(O.using("scored", body="""SELECT query_id, chunk_id, round(CAST(0.5 * CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0 END + 0.5 * coalesce(rerank_score, 0.0) AS DECIMAL(18, 12)), 6)::DOUBLE AS fused_score
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS low, max(score) OVER (PARTITION BY query_id) AS high FROM scored)"""))
def fused_score(spark, sf):
    return R.fused_score(_reranked_candidates(spark, sf)).select("query_id", "chunk_id", "fused_score")


@query(O.using("queries", "reranked", body="""SELECT query_id, coalesce(kept, 0)::BIGINT AS kept,
    CASE WHEN hits IS NULL THEN 'no_context' WHEN kept = 0 THEN 'low_confidence' ELSE 'normal' END AS mode
  FROM (SELECT query_id FROM queries) LEFT JOIN (SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE rerank_score >= 0.1) AS kept FROM reranked GROUP BY query_id) USING (query_id)"""))
def low_rerank_threshold(spark, sf):
    ranked = S.rerank_topk(_reranked_candidates(spark, sf), 5)
    return R.low_rerank_threshold(A.queries(spark, sf), ranked, 0.1)


@query(O.using("top5", "vectors", body="""SELECT query_id, doc_id, min(chunk_index)::INTEGER AS first_index, max(chunk_index)::INTEGER AS last_index, count(*) AS chunks
  FROM (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS island
    FROM (SELECT DISTINCT query_id, doc_id, unnest([chunk_index - 1, chunk_index, chunk_index + 1]) AS chunk_index FROM top5)
    SEMI JOIN vectors USING (doc_id, chunk_index)) GROUP BY query_id, doc_id, island"""))
def merge_adjacent_hits(spark, sf):
    return R.merge_adjacent_hits(S.vector_topk(A.queries(spark, sf), A.vectors(spark, sf), 5), A.vectors(spark, sf))
