"""First-request windows: both batch ways and the keyed state against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import rate_limit as L
from chunkloom.session import scratch_path
from chunkloom.streaming import rate_limit as SR, runner as R


def plain(rows, window, limit):
    state, out = {}, {}
    for t, request, key in sorted((t, r, k) for r, k, t in rows):
        start, n = state.get(key, (None, 0))
        if start is None or t - start >= window:
            start, n = t, 0
        state[key] = (start, n + 1)
        out[request] = (n + 1, n + 1 <= limit)
    return out


def requests(seed=1):
    """One dense key, some sparse ones, equal times and exact window edges."""
    rng = random.Random(seed)
    rows = [(i, 0, rng.randrange(0, 3000 * 1_000_000)) for i in range(3000)]
    rows += [(10_000 + i, 1 + i % 7, rng.randrange(0, 40) * 5_000_000) for i in range(400)]
    rows += [(20_000 + i, 9, i * 10_000_000) for i in range(200)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id long, key long, t long").select("request_id", "key", F.timestamp_micros("t").alias("ts"))


@pytest.mark.parametrize("hot_rows", [0, 150, 1_000_000])
@pytest.mark.parametrize("window", [10, 37])
def test_batch(spark, hot_rows, window):
    rows = requests(window)
    got = L.fixed_window_limit(frame(spark, rows), "key", "ts", "request_id", window, 4, hot_rows=hot_rows).collect()
    assert {r.request_id: (r["count"], r.allowed) for r in got} == plain(rows, window * 1_000_000, 4)
    assert all(r.remaining == max(0, 4 - r["count"]) for r in got)


def test_stream_over_batches(spark):
    rows = sorted(requests(5), key=lambda r: (r[2], r[0]))
    path = scratch_path(spark, "requests")
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("request_id long, key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = R.run_append(SR.rate_limit_stream(SR.as_requests(stream, "key", "ts", "request_id"), "key", 10, 4), "limits")
    assert {r.request_id: (r["count"], r.allowed) for r in out.collect()} == plain(rows, 10_000_000, 4)


def test_chain(spark):
    rows = [(1, 1, 1, 0), (2, 1, 2, 1), (3, 1, 1, 2), (4, 1, 1, 3), (5, 2, 1, 4), (6, 2, None, 5)]
    df = spark.createDataFrame(rows, "request_id long, ip long, user long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.request_id: (r.ip_allowed, r.user_count, r.allowed) for r in L.chained_limits(df, 60, 3, 2).collect()}
    # Request 4 fails at the address and never reaches the user counter.
    assert got == {1: (True, 1, True), 2: (True, 1, True), 3: (True, 2, True), 4: (False, None, False), 5: (True, 3, False), 6: (True, None, True)}


def test_a_hot_key_inside_one_window_is_many_blocks(spark, monkeypatch):
    rows = [(i, 0, i * 1000) for i in range(20_000)] + [(50_000 + i, 1, i * 3000) for i in range(50)]
    blocks = []
    whole = L._hot_starts
    monkeypatch.setattr(L, "_hot_starts", lambda times, *more: (blocks.append(times.groupBy("_key", "_block").count().collect()), whole(times, *more))[1])
    got = L.fixed_window_limit(frame(spark, rows), "key", "ts", "request_id", 86_400, 3, hot_rows=1000).collect()
    assert {r.request_id: (r["count"], r.allowed) for r in got} == plain(rows, 86_400 * 1_000_000, 3)
    assert len(blocks[0]) >= 15 and max(r["count"] for r in blocks[0]) <= 2000


def periodic(n, every, start=0):
    """Requests at even steps: no two windows that start at different requests ever meet."""
    return [(i, 0, start + i * every) for i in range(n)]


@pytest.mark.parametrize("rows, window, hot", [
    (periodic(20_000, 5_000), 10, 700),  # 200 requests a second: a window is three blocks
    (periodic(6_000, 5_000) + [(10_000 + i, 0, 90_000_000 + i * 7_000) for i in range(5_000)], 7, 300),  # with a gap
    ([(i, 0, (i // 50) * 60_000_000 + i % 50) for i in range(5_000)], 90, 100),  # bursts with empty blocks between
])
def test_dense_keys_are_followed_by_jumps(spark, monkeypatch, rows, window, hot):
    read = []
    whole = L._visited
    monkeypatch.setattr(L, "_visited", lambda blocks, *more: (read.append([len(r.entry) for r in blocks.collect()]), whole(blocks, *more))[1])
    got = L.fixed_window_limit(frame(spark, rows), "key", "ts", "request_id", window, 4, hot_rows=hot).collect()
    assert {r.request_id: (r["count"], r.allowed) for r in got} == plain(rows, window * 1_000_000, 4)
    # A task of any step holds a block's jump function and the two blocks that its windows end in.
    assert len(read[0]) > 10 and max(read[0]) <= 2 * hot


def test_a_narrow_key_does_not_narrow_the_others(spark, monkeypatch):
    rows = periodic(5_000, 1_000) + [(20_000 + i, 1 + i, i * 50_000_000) for i in range(300)]
    spans = []
    small = L._small_starts
    monkeypatch.setattr(L, "_small_starts", lambda times, span, window: (spans.append((span, times.where("_key > 0").groupBy("_key").count().count())), small(times, span, window))[1])
    got = L.fixed_window_limit(frame(spark, rows), "key", "ts", "request_id", 10, 4, hot_rows=500).collect()
    assert {r.request_id: (r["count"], r.allowed) for r in got} == plain(rows, 10_000_000, 4)
    assert spans == [(640_000_000, 300)]


def test_jumps_of_random_keys(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, rng.choice([0, 0, 1]), rng.randrange(0, rng.choice([50, 400]) * 1_000_000)) for i in range(4_000)]
        window, hot = rng.choice([3, 20, 100]), rng.choice([65, 300])
        got = L.fixed_window_limit(frame(spark, rows), "key", "ts", "request_id", window, 4, hot_rows=hot).collect()
        assert {r.request_id: (r["count"], r.allowed) for r in got} == plain(rows, window * 1_000_000, 4)
