"""BM25 with upper bounds against scoring everything."""

import random

import pytest

from chunkloom.operators import training as R


def tables(spark, seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    chunks = [(i, 0 if i % 3 else i % 5, text(draw.randint(0, 40))) for i in range(400)] + [(1000 + i, 0, text(3)) for i in range(20)]
    asked = [(i, 0 if i % 2 else i % 5, text(draw.randint(0, 12))) for i in range(60)] + [(100, 0, None), (101, 7, "w1 w2")]
    return spark.createDataFrame(asked, "query_id long, doc_id long, question string"), spark.createDataFrame(chunks, "chunk_id long, doc_id long, content string")


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_bounds_change_no_result(spark, n):
    queries, corpus = tables(spark)
    got, report = R.bm25_best(queries, corpus, n)
    want = R.best_candidates(R.bm25_scores(queries, corpus), n)
    columns = ["query_id", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    row = report.head()
    assert row.scored <= row.postings
    if n == 1:
        assert row.scored < 0.7 * row.postings


def test_no_queries_and_no_chunks(spark):
    queries, corpus = tables(spark)
    assert R.bm25_best(queries.limit(0), corpus, 2)[0].count() == 0
    assert R.bm25_best(queries, corpus.limit(0), 2)[0].count() == 0
