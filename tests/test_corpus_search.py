"""Corpus-wide search against brute force, and what its bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import corpus_search as C


def table(spark, data, repeat=1):
    rows = [(i + j * len(data), i % 7, v.tolist()) for j in range(repeat) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<float>").repartition(4)


def clustered(n, centres=12, dim=16, spread=0.05, seed=2):
    draw = np.random.default_rng(seed)
    at = draw.normal(size=(centres, dim))
    return (at[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dim))).astype("float32")


def brute(queries, data, k):
    out = {}
    for i, q in queries:
        best = sorted((-round(float(q.astype("f8") @ v.astype("f8")), 6), j) for j, v in enumerate(data))[:k]
        out[i] = [(rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return out


def found(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
@pytest.mark.parametrize("k, block", [(1, 8), (5, 40), (1000, 64)])
def test_hits_equal_brute_force(spark, monkeypatch, broadcast_bytes, k, block):
    monkeypatch.setattr(C, "QUERY_BLOCK", 9)
    monkeypatch.setattr(C, "PAGE", 5)
    draw = np.random.default_rng(1)
    data = draw.integers(-2, 3, size=(300, 6)).astype("float32")  # few distinct values: ties are common
    data[::3] = data[0]  # a third of the corpus is one vector
    v = table(spark, data)
    q = v.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    hits, report = C.search_corpus(q, C.build_index(v, 7, block), k, broadcast_bytes)
    assert found(hits) == brute([(i, data[i]) for i in range(0, 300, 10)], data, k)
    row = report.head()
    assert row.alive <= row.pairs and row.pairs % 30 == 0


def test_bounds_leave_out_most_blocks_of_clustered_vectors(spark):
    data = clustered(4000)
    v = table(spark, data)
    index = C.build_index(v, 48, 50)
    assert index.agg(F.sum("size")).head()[0] == 4000
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    hits, report = C.search_corpus(q, index, 5)
    assert found(hits) == brute([(i, data[i]) for i in range(0, 4000, 100)], data, 5)
    row = report.head()
    assert row.alive < 0.4 * row.pairs


def test_blocks_hold_what_their_centroid_and_radius_say(spark):
    data = clustered(500)
    for row in C.build_index(table(spark, data), 5, 30).collect():
        x = np.array(row.matrix).reshape(row.size, -1)
        assert np.allclose(x, data[row.chunk_ids]) and [i % 7 for i in row.chunk_ids] == row.doc_ids
        assert np.sqrt(((x - row.centroid) ** 2).sum(axis=1)).max() <= row.radius + 1e-6


def test_awkward_tables(spark):
    v = table(spark, clustered(40))
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    no_vector = spark.createDataFrame([(900, 1, None), (901, 1, [])], v.schema)
    index = C.build_index(v.union(no_vector), 4, 10)
    none = no_vector.select(F.col("chunk_id").alias("query_id"), "embedding")
    hits, _ = C.search_corpus(q.union(none), index, 3)
    assert hits.count() == 120 and hits.where("query_id >= 900 or chunk_id >= 900").count() == 0
    assert C.search_corpus(q.limit(0), index, 3)[0].count() == 0
    assert C.search_corpus(q, C.build_index(v.limit(0)), 3)[0].count() == 0
