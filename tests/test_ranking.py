"""Blocked running sums and exact percentiles against brute force, with one hot key."""

import random

import numpy as np
from pyspark.sql import functions as F

from chunkloom.operators import ranking as K


def test_ordered_index_with_gaps_and_hot_key(spark):
    rng = random.Random(3)
    rows = [(1, p) for p in rng.sample(range(50_000), 6000)] + [(k, p) for k in range(2, 40) for p in rng.sample(range(9000), 5)]
    df = spark.createDataFrame(rows, "doc_id long, pos long")
    got = {(r.doc_id, r.pos): r.ix for r in K.ordered_index(df, "doc_id", "pos", "ix", block_size=100).collect()}
    expected = {}
    for key in {k for k, _ in rows}:
        for i, p in enumerate(sorted(p for k, p in rows if k == key)):
            expected[key, p] = i
    assert got == expected


def test_running_totals_without_key(spark):
    values = [(t, (t * 7) % 5 - 2) for t in range(0, 3000, 3)]
    df = spark.createDataFrame(values, "t long, v long")
    got = K.running_totals(df, [], F.floor(F.col("t") / 50), [F.col("t")], {"s": F.col("v")}).collect()
    sums = np.cumsum([v for _, v in values])
    assert {r.t: r.s for r in got} == {t: int(s) for (t, _), s in zip(values, sums)}


def test_percentiles(spark):
    rng = random.Random(5)
    series = {"a": [1, 2, 3, 3.3, 10, 57], "b": [rng.randint(-500, 5000) for _ in range(3001)], "c": [4.0], "d": [7.0] * 50}
    rows = [(k, float(v)) for k, values in series.items() for v in values] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r for r in K.exact_percentiles(K.value_counts(df, ["k"]), ["k"], {"p50": 50, "p95": 95, "p99": 99}).collect()}
    for key, values in series.items():
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert abs(got[key][name] - np.percentile(values, p)) < 1e-9
    assert [round(got["a"][n], 6) for n in ("p50", "p95", "p99")] == [3.15, 45.25, 54.65]


def test_an_outlier_leaves_the_buckets_even(spark):
    values = [float(i) for i in range(20_000)] + [1e12, -1e12]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, value double")
    hist = K.value_counts(df, ["k"])
    sizes = [r["count"] for r in K.value_buckets(hist, ["k"], 64).where("k = 'a'").groupBy("_b").count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 2 * len(values) / 64
    got = {r.k: r for r in K.exact_percentiles(hist, ["k"], {"p50": 50, "p99": 99}).collect()}
    assert got["a"].p50 == np.percentile(values, 50) and abs(got["a"].p99 - np.percentile(values, 99)) < 1e-6 and got["b"].p99 == 1.0


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = K.top_n(df, ["k"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
