"""Late rows in closed windows, sketches of active sessions, out-of-order deltas and state that ends."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from chunkloom.session import scratch_path
from chunkloom.streaming import deltas as W, metrics as SM, panes as P, rate_limit as SR

THINK = re.compile(r"<think\b[^>]*>.*?(?:</think>|\Z)", re.IGNORECASE | re.DOTALL)
START = 1_700_000_000


def deliveries(spark, rows, schema, parts, name):
    """A stream of the rows, one batch for each part."""
    path = scratch_path(spark, name)
    for part in parts:
        spark.createDataFrame([r for i, r in enumerate(rows) if i in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def requests(n=900):
    draw = random.Random(3)
    schema = "id long, request_type string, status string, timed_out boolean, no_context boolean, e2e_latency_ms int, created_at timestamp"
    rows = []
    for i in range(n):
        at = datetime.datetime.fromtimestamp(START + i * 7 + draw.random(), datetime.timezone.utc)
        value = None if i % 11 == 0 else draw.choice([5, 10, 10, 400, 7])
        rows.append((i, draw.choice(["chat_async", "chat_stream", "ingest"]), draw.choice(["success", "success", "failed"]), i % 5 == 0, draw.choice([True, False, None]), value, at))
    return rows, schema


@pytest.mark.parametrize("window, slide", [(300, 300), (300, 60), (240, 90)])
def test_windows_of_panes_equal_the_batch_with_late_rows(spark, window, slide):
    rows, schema = requests()
    late = {i for i in range(300) if i % 3 == 0}
    parts = [set(range(300)) - late, set(range(300, 900)), late]
    stream = deliveries(spark, rows, schema, parts, "requests")
    panes = P.drain(stream, P.pane_seconds(window, slide), 600, scratch_path(spark, "panes"), scratch_path(spark, "panes-state"))
    got = P.windows(panes, window, slide)
    want = SM.windowed_metrics(spark.createDataFrame(rows, schema), window, slide)
    assert sorted(map(str, got.drop("late_rows").collect())) == sorted(map(str, want.select(got.drop("late_rows").columns).collect()))
    came_late = panes.where("late").agg(F.sum("total")).head()[0]
    assert came_late == len(late)
    # Each row is counted in one pane, however many windows it belongs to.
    assert panes.agg(F.sum("total")).head()[0] == len(rows)
    assert got.agg(F.sum("late_rows")).head()[0] == {(300, 300): 1, (300, 60): 5}.get((window, slide), 0) * len(late) or slide == 90


def test_active_now(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(4000) if i % 50 else None, datetime.datetime.fromtimestamp(START + draw.randrange(7200), datetime.timezone.utc)) for i in range(9000)]
    stream = deliveries(spark, rows, "session_id long, created_at timestamp", [set(range(0, 9000, 2)), set(range(1, 9000, 2))], "activity")
    kept = P.drain_activity(stream, 60, scratch_path(spark, "kept"), scratch_path(spark, "kept-state"))
    got = {int(r.pane_start.timestamp()): (r.sessions, r.estimate) for r in P.active_now(*kept, 60, 1800).collect()}
    want = {}
    for session, at in rows:
        if session is not None:
            pane = int(at.timestamp()) // 60 * 60
            for k in range(30):
                want.setdefault(pane + 60 * k, set()).add(session)
    assert {p: s for p, (s, _) in got.items()} == {p: len(s) for p, s in want.items()}
    assert max(abs(e - s) / s for s, e in got.values() if s > 100) < 0.06


def shown(spark, stream, **more):
    """(index, delta) by stream, and the rows left in the state."""
    out, state = scratch_path(spark, "shown"), scratch_path(spark, "shown-state")
    query = W.think_filter(stream, **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    found = {}
    for r in spark.read.schema("stream_id long, index long, delta string").parquet(out).collect():
        found.setdefault(r.stream_id, []).append((r["index"], r.delta))
    return {i: "".join(d for _, d in sorted(v)) for i, v in found.items()}, left


EVENT = "stream_id long, index long, type string, delta string, ts timestamp"
TEXTS = {1: "plain answer", 2: "x<think>hidden</think>y", 3: "<think>all of it", 4: "a < b <thinker> c<thi", 5: "one<THINK a>two</think>three<think>four"}


def delta_rows(ends=True):
    draw, rows = random.Random(7), []
    for stream, text in TEXTS.items():
        pieces = [text[i : i + 3] for i in range(0, len(text), 3)]
        at = lambda i: datetime.datetime.fromtimestamp(START + stream + i / 10, datetime.timezone.utc)  # noqa: E731, B023
        rows += [(stream, i, "delta", p, at(i)) for i, p in enumerate(pieces, 1)]
        if ends:
            rows.append((stream, len(pieces) + 1, "done", None, at(len(pieces) + 1)))
    draw.shuffle(rows)
    return rows


def test_deltas_in_any_order_give_the_same_answer_and_leave_no_state(spark):
    rows = delta_rows()
    rows += rows[:4]  # and some come twice
    parts = [{i for i in range(len(rows)) if i % 4 == k} for k in range(4)]
    got, left = shown(spark, deliveries(spark, rows, EVENT, parts, "deltas"))
    assert {i: got.get(i, "") for i in TEXTS} == {i: THINK.sub("", t) for i, t in TEXTS.items()}
    assert left == 0


def test_streams_that_never_end_are_closed_by_the_timer(spark):
    rows = delta_rows(ends=False)
    gap = [r for r in rows if not (r[0] == 1 and r[1] == 2)]  # one delta never comes
    beat = (99, 1, "done", None, datetime.datetime.fromtimestamp(START + 100_000, datetime.timezone.utc))
    parts = [set(range(len(gap))), {len(gap)}]
    got, left = shown(spark, deliveries(spark, [*gap, beat], EVENT, parts, "deltas"), idle_seconds=60)
    want = {i: THINK.sub("", t) for i, t in TEXTS.items()} | {1: "plaanswer"}
    assert {i: got.get(i, "") for i in TEXTS} == want and left == 0


def test_rate_limit_state_ends_with_its_window(spark):
    at = lambda s: datetime.datetime.fromtimestamp(START + s, datetime.timezone.utc)
    rows = [(k, k, at(k % 7)) for k in range(200)] + [(1000, 0, at(5_000)), (1001, 0, at(5_001))]
    stream = deliveries(spark, rows, "request_id long, key long, ts timestamp", [set(range(200)), {200}, {201}], "requests")
    out, state = scratch_path(spark, "limits"), scratch_path(spark, "limits-state")
    limited = SR.rate_limit_stream(SR.as_requests(stream, "key", "ts", "request_id"), "key", 10, 4)
    query = limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    got = {r.request_id: r["count"] for r in spark.read.schema(limited.schema).parquet(out).collect()}
    assert got == {k: 1 for k in range(200)} | {1000: 1, 1001: 2} and left == 1
