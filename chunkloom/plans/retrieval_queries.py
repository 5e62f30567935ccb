"""Search, rerank, context, prompts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom import constants as K
from chunkloom.functions import text as T
from chunkloom.functions.vectors import l2_normalize
from chunkloom.operators import context as X, corpus_search as C, embedding as M, evaluation as V, prompts as P, retrieval as S
from chunkloom.operators.chunks import index_row_id
from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query
from chunkloom.session import written


def _top(spark, sf, k):
    return S.vector_topk(A.queries(spark, sf), A.vectors(spark, sf), k)


def _candidates(spark, sf):
    """Top-30 hits with text and question."""
    hits = _top(spark, sf, K.CANDIDATE_TOP_K).withColumnRenamed("rank", "original_rank")
    texts = A.vector_contents(spark, sf).withColumn("snippet", F.lit(""))
    return S.rerank_pairs(hits, A.queries(spark, sf), texts)


def _scored(spark, sf):
    hits = _top(spark, sf, K.CANDIDATE_TOP_K).withColumnRenamed("rank", "original_rank")
    return M.token_overlap(hits, A.queries(spark, sf), A.vector_contents(spark, sf))


def _reranked(spark, sf, k=5):
    return S.rerank_topk(_scored(spark, sf), k)


HIT = "query_id, doc_id, chunk_id, chunk_index, score"


@query(O.using("top5", body=f"SELECT {HIT}, rank::INTEGER AS rank FROM top5"))
def vector_topk(spark, sf):
    return _top(spark, sf, 5)


@query(O.using("pair_scores", body="""SELECT query_id, count(*) AS pairs, max(score) AS best, min(score) AS worst
  FROM pair_scores GROUP BY query_id"""))
def score_query_vs_chunks(spark, sf):
    return S.score_query_vs_chunks(A.queries(spark, sf), A.vectors(spark, sf))


@query(O.using("vectors", body="""SELECT query_id, doc_id, chunk_id, score, rank FROM (SELECT *,
    (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank
  FROM (SELECT q.chunk_id AS query_id, v.doc_id, v.chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM vectors q JOIN vectors v ON q.chunk_id % 50 = 0)) WHERE rank <= 10"""))
def score_query_vs_corpus(spark, sf):
    """Every fiftieth vector asks the whole corpus."""
    v = A.vectors(spark, sf)
    asked = v.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return C.search_corpus(asked, C.build_index(v), 10)[0].select("query_id", "doc_id", "chunk_id", "score", "rank")


@query("""SELECT q AS k, greatest(1, CASE WHEN q = 0 THEN 1 ELSE q END) AS at_least_one, least(20, greatest(1, CASE WHEN q = 0 THEN 1 ELSE q END)) AS ui,
    count(*) AS requests FROM (SELECT (l_quantity - 10)::INTEGER AS q FROM lineitem) GROUP BY q""")
def validate_topk(spark, sf):
    k = (F.col("l_quantity") - 10).cast("int")
    asked = A.table(spark, sf, "lineitem").select(k.alias("k")).groupBy("k").agg(F.count("*").alias("requests"))
    return asked.select(
        "k", S.validate_topk(F.col("k")).alias("at_least_one"), S.validate_topk(F.col("k"), high=20).alias("ui"), "requests"
    )


@query(O.using("vectors", body="""SELECT query_id, r.doc_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'READY' THEN 'not_ready'
    WHEN model <> 'm1' THEN 'model_mismatch' END AS reject_reason,
    coalesce(status = 'READY' AND model = 'm1', false) AS usable
  FROM (SELECT chunk_id AS query_id, doc_id + chunk_index % 2 AS doc_id FROM vectors) r
  LEFT JOIN (SELECT DISTINCT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'm0' ELSE 'm1' END AS model,
    CASE WHEN doc_id % 10 = 4 THEN 'BUILDING' ELSE 'READY' END AS status FROM vectors) USING (doc_id)"""))
def guard_index_usable(spark, sf):
    asked = A.vectors(spark, sf).select(
        F.col("chunk_id").alias("query_id"), (F.col("doc_id") + F.col("chunk_index") % 2).alias("doc_id")
    )
    return S.guard_index_usable(asked, A.index_meta(spark, sf), A.MODEL).select("query_id", "doc_id", "reject_reason", "usable")


@query(O.using("vectors", body="""SELECT hit_id, doc_id, row_id, chunk_id, chunk_index FROM
    (SELECT event_id AS hit_id, user_id % 10 AS doc_id, (event_id % 60 - 5)::INTEGER AS row_id FROM events) JOIN
    (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INTEGER AS row_id FROM vectors) USING (doc_id, row_id)"""))
def hits_to_chunks(spark, sf):
    e = A.table(spark, sf, "events")
    hits = e.select(
        F.col("event_id").alias("hit_id"),
        (F.col("user_id") % 10).alias("doc_id"),
        (F.col("event_id") % 60 - 5).cast("int").alias("row_id"),
    )
    mapping = index_row_id(A.vectors(spark, sf).select("doc_id", "chunk_id", "chunk_index"))
    return S.hits_to_chunks(hits, mapping).select("hit_id", "doc_id", "row_id", "chunk_id", "chunk_index")


@query(O.using("candidates", "contents", body="""SELECT query_id, chunk_id, original_rank::INTEGER AS original_rank, question, content
  FROM candidates JOIN contents USING (chunk_id)"""))
def rerank_pairs(spark, sf):
    return _candidates(spark, sf).select("query_id", "chunk_id", "original_rank", "question", "content")


@query(O.using("scored", body="SELECT query_id, chunk_id, rerank_score FROM scored"))
def rerank_score(spark, sf):
    return _scored(spark, sf).select("query_id", "chunk_id", "rerank_score")


@query(O.using("ranked", body="SELECT query_id, chunk_id, score, original_rank::INTEGER AS original_rank FROM ranked WHERE original_rank <= 30"))
def keep_original_rank(spark, sf):
    pairs = _top(spark, sf, K.CANDIDATE_TOP_K).drop("rank")
    return S.keep_original_rank(pairs, K.CANDIDATE_TOP_K).select("query_id", "chunk_id", "score", "original_rank")


@query(O.using("top5", body="SELECT query_id, chunk_id, score, rank::INTEGER AS rank, score AS vector_score FROM top5"))
def assign_final_rank(spark, sf):
    order = [F.desc("score"), F.asc("chunk_index"), F.asc("chunk_id")]
    hits = _top(spark, sf, 10).drop("rank")
    return S.assign_final_rank(hits, order, 5).select("query_id", "chunk_id", "score", "rank", "vector_score")


_RERANKED = O.using("reranked", body=f"""SELECT {HIT}, rerank_score, original_rank::INTEGER AS original_rank, rank::INTEGER AS rank FROM reranked""")


@query(_RERANKED)
def two_phase_topk(spark, sf):
    out = S.two_phase_topk(A.queries(spark, sf), A.vectors(spark, sf), A.vector_contents(spark, sf), M.token_overlap, 5)
    return out.select("query_id", "doc_id", "chunk_id", "chunk_index", "score", "rerank_score", "original_rank", "rank")


@query(_RERANKED)
def rerank_topk(spark, sf):
    return _reranked(spark, sf).select(
        "query_id", "doc_id", "chunk_id", "chunk_index", "score", "rerank_score", "original_rank", "rank"
    )


@query(O.using("scored", body="""SELECT query_id, chunk_id, rank::INTEGER AS rank, NOT failed AS used, failed AS fallback,
    CASE WHEN failed THEN 'faiss' ELSE 'cross_encoder' END AS provider, candidate_count, least(candidate_count, 5) AS returned_count
  FROM (SELECT *, query_id % 3 = 0 AS failed, count(*) OVER (PARTITION BY query_id) AS candidate_count,
      row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 3 <> 0 THEN rerank_score END DESC NULLS LAST, score DESC, original_rank) AS rank
    FROM scored) WHERE rank <= 5"""))
def rerank_fallback(spark, sf):
    """The scorer loses one candidate of every third query."""
    lost = (F.col("query_id") % 3 == 0) & (F.col("original_rank") == 2)
    scored = _scored(spark, sf).withColumn("rerank_score", F.when(~lost, F.col("rerank_score")))
    return S.rerank_fallback(scored, 5).select(
        "query_id", "chunk_id", "rank", "used", "fallback", "provider", "candidate_count", "returned_count"
    )


@query(O.using("marked5", body="SELECT query_id, chunk_id, rank::INTEGER AS rank, relevant FROM marked5"))
def hits_vs_labels(spark, sf):
    return V.hits_vs_labels(_top(spark, sf, 5), A.relevance(spark, sf)).select("query_id", "chunk_id", "rank", "relevant")


@query(O.using("labels_set", body="SELECT query_id, label_kind, value FROM labels_set"))
def label_set(spark, sf):
    twice = A.relevance(spark, sf)
    nulls = twice.withColumn("value", F.lit(None).cast("long"))
    return V.label_set(twice.unionByName(twice).unionByName(nulls))


_MACRO = """SELECT coalesce(nullif(count(recall_at_k), 0), nullif(count(mrr), 0), count(ndcg)) AS retrieval_eval_samples,
  round(avg(recall_at_k), 4) AS recall_at_k_avg, round(avg(mrr), 4) AS mrr_avg, round(avg(ndcg), 4) AS ndcg_avg FROM eval5"""


@query(O.using("eval5", body="SELECT * FROM eval5"))
def retrieval_eval(spark, sf):
    return V.retrieval_eval(_top(spark, sf, 5), A.relevance(spark, sf))


@query(O.using("eval5", body=_MACRO))
def retrieval_eval_macro(spark, sf):
    return V.retrieval_eval_macro(V.retrieval_eval(_top(spark, sf, 5), A.relevance(spark, sf)))


@query(O.using("ranked", "labels_set", "relevant_counts", body="""SELECT k, count(*) AS queries, round(avg(round(matched / relevant_count, 6)), 4) AS recall,
    round(avg(coalesce(round(1.0 / first_rank, 6), 0.0)), 4) AS mrr,
    round(avg(round(dcg / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(relevant_count, hits) + 1) t(i)), 6)), 4) AS ndcg
  FROM (SELECT query_id, k, any_value(relevant_count) AS relevant_count, count(rank) AS hits, count(*) FILTER (WHERE relevant) AS matched,
      min(rank) FILTER (WHERE relevant) AS first_rank, coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE relevant), 0.0) AS dcg
    FROM (SELECT query_id, relevant_count, unnest([1, 5, 10]) AS k FROM relevant_counts) b
    LEFT JOIN (SELECT query_id AS qid, original_rank AS rank, EXISTS (SELECT 1 FROM labels_set l WHERE l.query_id = r.query_id
        AND ((label_kind = 'id' AND value = chunk_id) OR (label_kind = 'index' AND value = chunk_index))) AS relevant FROM ranked r WHERE original_rank <= 10) m
      ON m.qid = b.query_id AND m.rank <= b.k
    GROUP BY query_id, k) GROUP BY k"""))
def metrics_at_k_grid(spark, sf):
    return V.metrics_at_k_grid(_top(spark, sf, 10), A.relevance(spark, sf))


@query(O.using("marked5", body="""SELECT query_id, (min(rank) FILTER (WHERE relevant))::INTEGER AS first_rank,
    coalesce(round(1.0 / min(rank) FILTER (WHERE relevant), 6), 0.0) AS reciprocal_rank FROM marked5 GROUP BY query_id"""))
def first_relevant_rank(spark, sf):
    return V.first_relevant_rank(V.hits_vs_labels(_top(spark, sf, 5), A.relevance(spark, sf)))


# --- context ---------------------------------------------------------------


def _raw_hits(spark, sf):
    """Top-10 hits whose contents repeat, are blank or hide under other names."""
    hits = _top(spark, sf, 10).withColumnRenamed("rank", "position")
    joined = hits.join(X.cut_contents(A.vector_contents(spark, sf)), "chunk_id")
    shape = F.col("chunk_id") % 5
    body = F.col("content")
    shared = F.concat(F.lit("shared "), (F.col("chunk_id") % 3).cast("string"))
    return joined.select(
        "query_id",
        "position",
        "doc_id",
        F.when(shape != 1, F.col("chunk_id")).alias("chunk_id"),
        F.when(shape == 1, F.col("chunk_id")).alias("id"),
        F.when(shape != 2, F.col("chunk_index")).alias("chunk_index"),
        F.when(shape == 2, F.col("chunk_index")).alias("seq"),
        F.when(shape == 0, body).when(shape == 3, F.lit(" \n ")).alias("content"),
        F.when(shape == 1, body).alias("text"),
        F.when(shape == 2, body).when(shape == 4, shared).alias("chunk_text"),
        F.when(F.col("query_id") % 9 == 0, F.lit("bad")).otherwise(F.col("score").cast("string")).alias("score"),
    )


_BODY = "CASE WHEN chunk_id % 5 = 3 THEN chr(32) || chr(10) || chr(32) WHEN chunk_id % 5 = 4 THEN 'shared ' || chunk_id % 3 ELSE content END"
_TRIMMED = O.strip(_BODY)
#: Texts are trimmed and cut once per chunk, before hits are joined to them.
O.cte("chunk_bodies", f"""SELECT chunk_id, {O.cut('body', 1000, "' ...'")} AS content FROM (SELECT chunk_id, {_TRIMMED} AS body FROM contents)""", "contents")
_NORMALIZED = (
    "normalized",
    """SELECT query_id, original_rank::INTEGER AS rank, content, doc_id,
    CASE WHEN chunk_id % 5 = 1 THEN chunk_id ELSE nullif(chunk_id, 0) END AS chunk_id, chunk_index,
    CASE WHEN query_id % 9 <> 0 THEN score END AS score
  FROM ranked JOIN chunk_bodies USING (chunk_id) WHERE original_rank <= 10""",
)
_CONTEXT = (
    "context",
    """SELECT * EXCLUDE (rank, first), row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank) AS first FROM normalized WHERE content <> '')
  WHERE first = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""",
)
FIELDS = "query_id, rank, content, doc_id, chunk_id, chunk_index, score"


def _context_sql(body: str, *names: str) -> str:
    return O.using("ranked", "chunk_bodies", *names, extra=(_NORMALIZED, _CONTEXT), body=body)


def _names():
    return FIELDS.split(", ")


@query(O.using("ranked", "chunk_bodies", extra=(_NORMALIZED,), body=f"SELECT {FIELDS} FROM normalized"))
def coalesce_hit_fields(spark, sf):
    return X.coalesce_hit_fields(_raw_hits(spark, sf)).select(*_names())


@query(O.using("ranked", "chunk_bodies", extra=(_NORMALIZED,), body=f"SELECT {FIELDS} FROM normalized WHERE content <> ''"))
def filter_empty_hits(spark, sf):
    return X.filter_empty_hits(X.coalesce_hit_fields(_raw_hits(spark, sf))).select(*_names())


@query(O.using("ranked", "chunk_bodies", extra=(_NORMALIZED,), body=f"""SELECT {FIELDS} FROM normalized WHERE content <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank) = 1"""))
def dedup_hits_keep_first(spark, sf):
    hits = X.filter_empty_hits(X.coalesce_hit_fields(_raw_hits(spark, sf)))
    return X.dedup_hits_keep_first(hits).select(*_names())


@query(_context_sql(f"SELECT {FIELDS} FROM context"))
def renumber_ranks(spark, sf):
    return X.assemble_context(_raw_hits(spark, sf)).select(*_names())


def _asked(spark, sf):
    """All questions; every seventh finds nothing."""
    q = A.queries(spark, sf).select("query_id", "doc_id", "question")
    found = X.assemble_context(_raw_hits(spark, sf)).where(F.col("query_id") % 7 != 0)
    # Read by the mode and by the prompt: searched once, stored.
    found = written(found, "context")
    return q, found, X.context_mode(q, found, min_score=0.999999)


_MODE = (
    "modes",
    """SELECT query_id, question, CASE WHEN c.rank IS NULL THEN 'no_context' WHEN score < 0.999999 THEN 'low_confidence' ELSE 'normal' END AS mode
  FROM queries LEFT JOIN (SELECT query_id, rank, score FROM context WHERE rank = 1 AND query_id % 7 <> 0) c USING (query_id)""",
)


def _mode_sql(body: str, *extra: tuple[str, str]) -> str:
    stored = ("vectors", "queries", "pair_scores", "ranked", "contents", "chunk_bodies", "normalized", "context", "modes", "blocks")
    return O.using("ranked", "chunk_bodies", "queries", extra=(_NORMALIZED, _CONTEXT, _MODE, *extra), body=body, stored=stored)


@query(_mode_sql("SELECT query_id, mode FROM modes"))
def context_mode(spark, sf):
    return _asked(spark, sf)[2].select("query_id", "mode")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_fill(template: str, *values: str) -> str:
    pieces = template.split("%s")
    out = [_sql_text(pieces[0])]
    for value, tail in zip(values, pieces[1:]):
        out += [value, _sql_text(tail)]
    return " || ".join(out)


_HEADER = f"""'[Chunk ' || rank || '] | doc_id=' || doc_id || ' | chunk_index=' || chunk_index
  || coalesce(' | score=' || {O.four('score')}, '')"""
_SECOND_CUT = f"CASE WHEN length(content) <= 1000 THEN content ELSE {O.rstrip('substring(content, 1, 1000)')} || chr(10) || '...[truncated]' END"
_BLOCKS = (
    "blocks",
    f"""SELECT query_id, {O.strip(f"string_agg({_HEADER} || chr(10) || {_SECOND_CUT}, chr(10) || chr(10) ORDER BY rank)")} AS context_text,
    count(*) AS context_count FROM context WHERE query_id % 7 <> 0 GROUP BY query_id""",
)


@query(_mode_sql("SELECT * FROM blocks", _BLOCKS))
def build_context_block(spark, sf):
    return P.context_blocks(_asked(spark, sf)[1])


_ASK = O.strip("question")


@query(_mode_sql(f"""SELECT query_id, mode, coalesce(context_count, 0) AS context_count, {_sql_text(K.SYSTEM_INSTRUCTION)} AS system_prompt,
    CASE mode WHEN 'no_context' THEN {_sql_fill(K.NO_CONTEXT_PROMPT, _ASK)}
      WHEN 'low_confidence' THEN {_sql_fill(K.LOW_CONFIDENCE_PROMPT, 'context_text', _ASK)}
      ELSE {_sql_fill(K.NORMAL_PROMPT, 'context_text', _ASK)} END AS user_prompt
  FROM modes LEFT JOIN blocks USING (query_id)""", _BLOCKS))
def build_prompts(spark, sf):
    _, found, modes = _asked(spark, sf)
    return P.build_prompts(modes, found)


_LINES = f"""string_agg(rank || '. [chunk_index=' || chunk_index || ', score=' || coalesce(score::VARCHAR, 'None') || '] ' || {O.strip('content')}, chr(10) ORDER BY rank)"""


@query(_mode_sql(f"""SELECT query_id, CASE WHEN lines IS NULL THEN {_sql_fill(K.TEMPLATE_ANSWER_EMPTY, 'question')}
    ELSE {_sql_fill(K.TEMPLATE_ANSWER_HEAD, 'question')} || chr(10) || lines || chr(10) || {_sql_text(K.TEMPLATE_ANSWER_TAIL)} END AS answer,
    CASE WHEN shorter IS NULL THEN {_sql_text(K.FALLBACK_ANSWER_EMPTY)}
    ELSE {_sql_text(K.FALLBACK_ANSWER_HEAD + chr(10) + chr(10))} || {_sql_fill(K.FALLBACK_ANSWER_QUESTION, _ASK)} || {_sql_text(chr(10) + chr(10) + K.FALLBACK_ANSWER_LIST + chr(10))}
      || shorter || {_sql_text(chr(10) + chr(10) + K.FALLBACK_ANSWER_TAIL)} END AS short_answer
  FROM queries LEFT JOIN (SELECT query_id, {_LINES} AS lines,
      string_agg(rank || '. ' || {O.cut(O.strip('content'), 200, "' ...'")}, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS shorter
    FROM context WHERE query_id % 7 <> 0 GROUP BY query_id) USING (query_id)"""))
def template_answer(spark, sf):
    q, found, _ = _asked(spark, sf)
    scored = found.withColumn("snippet", F.lit(""))
    short = P.fallback_answer(q, scored).withColumnRenamed("answer", "short_answer")
    return P.template_answer(q, scored).join(short, "query_id")


@query(_mode_sql(f"""SELECT query_id, mode, source AS answer_source, CASE source WHEN 'no_context' THEN {_sql_text(K.NO_CONTEXT_ANSWER)}
    WHEN 'llm' THEN 'answer ' || query_id ELSE 'fallback ' || query_id END AS answer
  FROM (SELECT *, CASE WHEN mode = 'no_context' THEN 'no_context' WHEN query_id % 4 = 1 THEN 'mock_fallback' ELSE 'llm' END AS source FROM modes)"""))
def answer_source(spark, sf):
    modes = _asked(spark, sf)[2]
    down = F.col("query_id") % 4 == 1
    named = lambda prefix: F.concat(F.lit(prefix), F.col("query_id").cast("string"))
    results = modes.withColumns(
        {
            "model_answer": F.when(~down, named("answer ")),
            "model_error": F.when(down, F.lit("timed out")),
            "fallback_answer": named("fallback "),
        }
    )
    return P.answer_source(results).select("query_id", "mode", "answer_source", "answer")


@query(O.using("vectors", body="""SELECT chunk_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) / n)), 6) AS total,
    round(sqrt(list_sum(list_transform(embedding, lambda x: ((x::DOUBLE * 3) / n) * ((x::DOUBLE * 3) / n)))), 6) AS norm
  FROM (SELECT *, greatest(sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE * 3), list_transform(embedding, lambda x: x::DOUBLE * 3))), 1e-12) AS n FROM vectors)"""), name="l2_normalize")
def l2_normalize_vectors(spark, sf):
    long = F.transform("embedding", lambda x: x.cast("double") * 3)
    v = A.vectors(spark, sf).select("chunk_id", l2_normalize(long).alias("u"))
    add = lambda f: F.aggregate("u", F.lit(0.0), lambda acc, x: acc + f(x))
    return v.select("chunk_id", F.round(add(lambda x: x), 6).alias("total"), F.round(F.sqrt(add(lambda x: x * x)), 6).alias("norm"))


_FLAT_TEXT = f"replace({O.strip('text')}, chr(10), ' ')"


@query(f"SELECT doc_id, {O.cut(_FLAT_TEXT, 180, chr(39) + '...' + chr(39))} AS snippet FROM documents")
def build_snippet(spark, sf):
    return A.texts(spark, sf).select("doc_id", T.build_snippet(F.col("text")).alias("snippet"))


_ONCE = O.cut("body", 1000, "' ...'")


@query(f"""SELECT doc_id, once AS context_text, CASE WHEN length(once) <= 1000 THEN once
    ELSE {O.rstrip('substring(once, 1, 1000)')} || chr(10) || '...[truncated]' END AS prompt_text
  FROM (SELECT doc_id, {_ONCE} AS once FROM (SELECT doc_id, {O.strip('text')} AS body FROM documents))""")
def truncate_for_context(spark, sf):
    once = A.texts(spark, sf).select("doc_id", T.truncate_hit(T.strip(F.col("text")), 1000).alias("context_text"))
    return once.withColumn("prompt_text", T.truncate_prompt(F.col("context_text"), 1000))


def _embedded_sql(source: str, key: str, text: str, unit: str = "v / nullif(norm, 0)") -> str:
    """The default model again: signed counts of words by md5 slots, at unit length. ``unit`` is a component of the vector."""
    return O.using(source, extra=(
        ("words", f"SELECT {key}, ('0x' || substring(md5(word), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '{O.WS}+'), lambda w: w <> '')) AS word FROM {source})"),
        ("slots", f"SELECT {key}, h % 64 AS slot, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM words GROUP BY ALL"),
        ("norms", f"SELECT {key}, sqrt(sum(v * v)) AS norm FROM slots GROUP BY {key}"),
    ), body=f"""SELECT {key}, 64 AS dimension, CASE WHEN any_value(norm) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
    coalesce(sum(round({unit} * 1000) * (slot + 1)), 0)::BIGINT AS digest FROM slots JOIN norms USING ({key}) GROUP BY {key}""")


def _embedded(df, key):
    from chunkloom.functions.vectors import l2_norm

    thousandths = F.transform("embedding", lambda x, i: F.round(x.cast("double") * 1000).cast("long") * (i + 1))
    digest = F.aggregate(thousandths, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(key, F.size("embedding").alias("dimension"), F.round(l2_norm(F.col("embedding")), 4).alias("norm"), digest.alias("digest"))


#: Vectors are arrays of floats, and so are their lengths: 7 / 80 as a double is 87.5 thousandths, as a float a little less.
_FLOATS = "(v / nullif(norm, 0)::FLOAT::DOUBLE)::FLOAT::DOUBLE"


@query(_embedded_sql("chunks", "chunk_id", "content", _FLOATS))
def embed_chunks(spark, sf):
    """Unit vectors of the default model for every chunk."""
    return _embedded(M.embed_chunks(A.chunks(spark, sf)), "chunk_id")


@query(_embedded_sql("queries", "query_id", "'query: ' || question"))
def embed_queries(spark, sf):
    return _embedded(M.embed_queries(A.queries(spark, sf).select("query_id", "question"), prefix="query: "), "query_id")
