"""Search, rerank, evaluation, context and prompts on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import context as X, embedding as M, evaluation as V, prompts as P, retrieval as S

HITS = "query_id long, position int, content string, text string, score double, doc_id long, chunk_index int"


def vectors(spark, n=300, docs=3, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    # Few distinct values, so that ties are common.
    data = rng.integers(-2, 3, size=(n, dim)).astype("float32")
    doc = lambda i: 0 if i % 3 else i % docs
    rows = [(i, doc(i), i, data[i].tolist()) for i in range(n)]
    return data, spark.createDataFrame(rows, "chunk_id long, doc_id long, chunk_index int, embedding array<float>")


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_topk_equals_brute_force(spark, monkeypatch, broadcast_bytes, k):
    monkeypatch.setattr(S, "VECTOR_BLOCK", 16)
    data, v = vectors(spark)
    docs = {r.chunk_id: r.doc_id for r in v.collect()}
    q = v.where(F.col("chunk_id") % 10 == 0).select(F.col("chunk_id").alias("query_id"), "doc_id", "embedding")
    got = {}
    for r in S.vector_topk(q, v, k, broadcast_bytes=broadcast_bytes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    for i in range(0, len(data), 10):
        mine = [c for c in docs if docs[c] == docs[i]]
        best = sorted(((-round(float(data[i] @ data[c]), 6), c) for c in mine))[:k]
        assert sorted(got[i]) == [(rank, c, -s) for rank, (s, c) in enumerate(best, 1)]


def test_topk_with_small_blocks(spark):
    data, v = vectors(spark, 90)
    q = v.select(F.col("chunk_id").alias("query_id"), "doc_id", "embedding")
    blocks = S.vector_blocks(v, 16)
    assert blocks.agg(F.max(F.size("chunk_ids"))).first()[0] <= 16
    assert blocks.agg(F.sum(F.size("chunk_ids"))).first()[0] == 90
    for few in (True, False):
        sizes = [r[0] for r in S.query_blocks(q, 7, few).select(F.size("query_ids")).collect()]
        assert max(sizes) == 7 and sum(sizes) == 90


def test_search_over_stored_blocks(spark):
    from chunkloom.session import scratch_path
    from chunkloom.sources.sinks import write_vector_blocks

    _, v = vectors(spark, 120)
    q = v.where(F.col("chunk_id") % 7 == 0).select((F.col("chunk_id") * 1000).alias("query_id"), "doc_id", "embedding")
    path = scratch_path(spark, "blocks")
    write_vector_blocks(v, path)
    stored = S.vector_topk(q, spark.read.parquet(path), 4)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, S.vector_topk(q, v, 4).collect()))


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rerank_score double, original_rank int")


def test_rerank_order_and_ties(spark):
    rows = [(1, 10, 0.9, 0.5, 1), (1, 11, 0.8, 0.7, 2), (1, 12, 0.8, 0.7, 3), (1, 13, 0.85, 0.7, 4)]
    got = S.rerank_topk(scored(spark, rows), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [13, 11, 12]
    assert S.rerank_topk(scored(spark, rows), 0).count() == 0


def test_rerank_fallback(spark):
    rows = [(1, 10, 0.9, 0.1, 1), (1, 11, 0.8, 0.7, 2), (2, 20, 0.9, None, 1), (2, 21, 0.8, 0.7, 2)]
    hits = S.rerank_fallback(scored(spark, rows), 5)
    order = {(r.query_id, r.rank): (r.chunk_id, r.original_rank) for r in hits.collect()}
    assert order == {(1, 1): (11, 2), (1, 2): (10, 1), (2, 1): (20, None), (2, 2): (21, None)}
    meta = {r.query_id: (r.enabled, r.used, r.fallback, r.provider, r.candidate_count, r.returned_count) for r in S.rerank_meta(hits).collect()}
    assert meta == {1: (True, True, False, "cross_encoder", 2, 2), 2: (False, False, True, "faiss", 2, 2)}
    off = S.rerank_meta(S.rerank_fallback(scored(spark, rows), 5, enabled=False)).collect()
    assert {(r.enabled, r.fallback, r.provider) for r in off} == {(False, False, "faiss")}


def test_model_scorer(spark):
    def load():
        return lambda pairs: np.array([len(q) + len(c) for q, c in pairs], dtype="float32")

    c = spark.createDataFrame([(1, 10), (1, 11)], "query_id long, chunk_id long")
    q = spark.createDataFrame([(1, "abc")], "query_id long, question string")
    t = spark.createDataFrame([(10, "x"), (11, "yyyy")], "chunk_id long, content string")
    got = M.rerank_with_model(load, batch_size=1)(c, q, t)
    assert {r.chunk_id: r.rerank_score for r in got.collect()} == {10: 4.0, 11: 7.0}
    short = M.rerank_with_model(lambda: lambda pairs: np.array([]))(c, q, t)
    with pytest.raises(Exception, match="count mismatch"):
        short.collect()


def test_embedding_checks(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, content string").coalesce(1)
    got = M.embed_chunks(rows, M.hashing_model(16)).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in got)
    with pytest.raises(Exception, match="2-D"):
        M.embed_chunks(rows, lambda: lambda texts: np.zeros(len(texts))).collect()
    with pytest.raises(Exception, match="count mismatch"):
        M.embed_chunks(rows, lambda: lambda texts: np.zeros((1, 3)), batch_size=2).collect()
    blank = spark.createDataFrame([(1, " \n")], "id long, question string")
    with pytest.raises(Exception, match="query text is empty"):
        M.embed_queries(blank).collect()


def test_evaluation_goldens(spark):
    hits = spark.createDataFrame(
        [(1, 1, 100, 0), (1, 2, 101, 1), (1, 3, 102, 2), (2, 1, 100, 0), (4, 1, 100, 5)],
        "query_id long, rank int, chunk_id long, chunk_index int",
    )
    labels = spark.createDataFrame(
        [(1, "id", 101), (1, "id", 101), (1, "id", None), (3, "id", 5), (4, "id", 100), (4, "index", 5)],
        "query_id long, label_kind string, value long",
    )
    got = {r.query_id: r[1:] for r in V.retrieval_eval(hits, labels).collect()}
    assert got[1] == (1, 1, 1.0, 0.5, 0.63093)
    assert got[3] == (1, 0, 0.0, 0.0, None)  # labelled, nothing found
    assert got[4] == (2, 1, 0.5, 1.0, 1.0)  # one chunk named both ways
    assert 2 not in got  # no labels, no measures
    grid = {r.k: (r.queries, r.recall) for r in V.metrics_at_k_grid(hits, labels, (1, 5)).collect()}
    assert grid == {1: (3, round(0.5 / 3, 4)), 5: (3, 0.5)}


def context(spark):
    raw = [
        (1, 1, None, "A 文本", 0.91, 1, 0),
        (1, 2, "A 文本", None, 0.89, 1, 1),
        (1, 3, "B 文本", None, 0.85, 1, 2),
        (1, 4, "   ", None, 0.50, 1, 3),
    ]
    return X.assemble_context(spark.createDataFrame(raw, HITS))


def test_context_golden(spark):
    got = context(spark).orderBy("rank").collect()
    assert [(r.rank, r.content, r.score, r.chunk_index) for r in got] == [(1, "A 文本", 0.91, 0), (2, "B 文本", 0.85, 2)]
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    modes = lambda low: {r.query_id: r.mode for r in X.context_mode(asked, context(spark), low).collect()}
    assert modes(0.0) == {1: "normal", 2: "no_context"}
    assert modes(0.95) == {1: "low_confidence", 2: "no_context"}


def test_prompt_golden(spark):
    rows = [(1, 1, "苹果是一种水果。", 1, 7, 0, 0.91, None, None), (1, 2, "苹果富含维生素。", 1, 8, 1, 0.88, 0.5, 2)]
    schema = "query_id long, rank int, content string, doc_id long, chunk_id long, chunk_index int, score double, rerank_score double, original_rank int"
    c = spark.createDataFrame(rows, schema)
    text = P.context_blocks(c).first().context_text
    assert text == (
        "[Chunk 1] | doc_id=1 | chunk_index=0 | score=0.9100\n苹果是一种水果。\n\n"
        "[Chunk 2] | doc_id=1 | chunk_index=1 | score=0.8800 | rerank_score=0.5000 | original_rank=2\n苹果富含维生素。"
    )
    asked = spark.createDataFrame([(1, " 苹果有什么特点？ ", "normal"), (2, "q", "no_context")], "query_id long, question string, mode string")
    prompts = {r.query_id: r for r in P.build_prompts(asked, c).collect()}
    assert prompts[1].user_prompt.startswith("已检索内容：\n\n[Chunk 1]") and "用户问题：\n苹果有什么特点？\n\n" in prompts[1].user_prompt
    assert prompts[2].context_count == 0 and prompts[2].user_prompt.startswith("当前没有检索到可用文档片段。")


def test_float_text(spark):
    values = [0.91, 1.0, 0.0, -0.5, 0.000123, 0.00001, 0.000012, 0.000009, 0.1234567]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(P.plain_float(F.col("v"))).collect()]
    assert got == [repr(round(v, 6)) for v in values]


def test_thousandths_of_floats_and_of_the_sql_agree(spark, tmp_path):
    """Counts of 79, 10, 7, 3 and 1 have the length 80, and 7 / 80 lies on the border of two thousandths."""
    import duckdb
    import hashlib
    from compare import compare
    from chunkloom.plans import catalog

    catalog.load()
    words = {}
    for i in range(200):
        words.setdefault(int(hashlib.md5(f"w{i}".encode()).hexdigest()[:8], 16) % 64, f"w{i}")
    text = " ".join(" ".join([w] * n) for w, n in zip(words.values(), (79, 10, 7, 3, 1)))
    spark.createDataFrame([(1, text), (2, "one two"), (3, "")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, "embed_chunks", catalog.QUERIES["embed_chunks"], catalog.ORACLE["embed_chunks"], str(tmp_path))[0] == []
