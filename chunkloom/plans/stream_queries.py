"""Structured Streaming runs over the given tables, and wire text of answer streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query
from chunkloom.plans.metric_queries import DAY, REQUESTS_SQL, scope_sql
from chunkloom.session import scratch_path
from chunkloom.sources import sinks, sse
from chunkloom.streaming import deltas as W, ingest as I, late as L, metrics as SM, panes as P, rate_limit as SR, runner as R, tasks as ST

CHAT, CHAT_OK = O.CHAT, O.CHAT_OK
#: Events of one file of a capture.
CAPTURE_EVENTS = 250_000


def _stream(spark, sf, name):
    schema = A.table(spark, sf, name).schema
    return R.read_stream(spark, sf, name, schema)


def _metric_stream(spark, sf):
    return A.request_metrics(_stream(spark, sf, "events"))


def _deliveries(rows):
    """The rows in three parts: the first half of the time, the second, and every tenth row of the first half, kept back to the end."""
    ends = rows.agg(F.unix_micros(F.min("created_at").cast("timestamp")).alias("a"), F.unix_micros(F.max("created_at").cast("timestamp")).alias("b")).head()
    second_half = F.unix_micros(F.col("created_at").cast("timestamp")) >= (ends["a"] + ends["b"]) / 2
    return rows, rows.withColumn("part", F.when(second_half, 1).when(F.col("id") % 10 == 0, 2).otherwise(0))


def _window_sql(slots: str) -> str:
    return O.using("metrics", extra=(("slots", slots),), body=f"""SELECT window_start, window_start + INTERVAL 300 SECOND AS window_end, count(*) AS total,
    count(*) FILTER (WHERE {CHAT}) AS chat, round((arg_max(e2e_latency_ms, id) FILTER (WHERE {CHAT_OK}))::DOUBLE, 1) AS e2e_last,
    round(round(avg(e2e_latency_ms) FILTER (WHERE {CHAT_OK}), 6), 1) AS e2e_avg, {O.quantile('e2e_latency_ms', 0.5, 1, CHAT_OK)} AS e2e_p50,
    {O.quantile('e2e_latency_ms', 0.95, 1, CHAT_OK)} AS e2e_p95, {O.quantile('e2e_latency_ms', 0.99, 1, CHAT_OK)} AS e2e_p99,
    round(count(*) FILTER (WHERE status <> 'success') / count(*), 4) AS error_rate, round(count(*) FILTER (WHERE timed_out) / count(*), 4) AS timeout_rate,
    round(count(*) FILTER (WHERE {CHAT_OK} AND no_context) / nullif(count(*) FILTER (WHERE {CHAT_OK}), 0), 4) AS no_context_ratio,
    round(count(*) FILTER (WHERE {CHAT}) / 300, 3) AS qps FROM slots GROUP BY window_start""")


@query(_window_sql("SELECT *, time_bucket(INTERVAL 300 SECOND, created_at) AS window_start FROM metrics"))
def stream_metrics_tumbling(spark, sf):
    """Three deliveries to one stream, the last with rows of windows that are closed by then; all count."""
    rows, parts = _deliveries(A.metrics(spark, sf))
    path, out, state = (scratch_path(spark, n) for n in ("metric-rows", "panes", "panes-state"))
    for part in range(3):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(path)
        panes = P.drain(spark.readStream.schema(rows.schema).parquet(path), P.pane_seconds(300, 300), 3600, out, state)
    return P.windows(panes, 300).drop("late_rows")


@query(_window_sql("""SELECT *, time_bucket(INTERVAL 60 SECOND, created_at) - to_seconds(60 * k) AS window_start
  FROM metrics, (SELECT unnest([0, 1, 2, 3, 4]) AS k)"""))
def stream_metrics_sliding(spark, sf):
    return P.run_windows(_metric_stream(spark, sf), 300, 60, 3600).drop("late_rows")


@query(O.using("deltas", body="SELECT stream_id, index, delta FROM deltas"))
def stream_delta_split(spark, sf):
    return W.split_deltas(A.answers(spark, sf))


@query(O.using("answers", body="""SELECT stream_id, answer, CASE WHEN session_id % 13 = 0 THEN 'stream closed before done event'
  WHEN session_id % 17 = 3 THEN 'model went away' END AS error FROM answers"""))
def stream_reassemble(spark, sf):
    return W.reassemble(A.stream_events(A.answers(spark, sf)))


@query(O.using("stream_events", body="""SELECT stream_id, epoch_ms(min(ts) FILTER (WHERE type = 'delta')) - epoch_ms(min(requested_at)) AS ttft_ms,
  epoch_ms(min(ts) FILTER (WHERE type = 'done')) - epoch_ms(min(requested_at)) AS e2e_ms FROM stream_events GROUP BY stream_id"""))
def stream_ttft(spark, sf):
    return W.stream_timing(A.stream_events(A.answers(spark, sf)))


@query(O.using("stream_events", body="""SELECT 'data: ' || CASE type
    WHEN 'delta' THEN '{"type": "delta", "delta": ' || to_json(delta)::VARCHAR || ', "index": ' || index || '}'
    WHEN 'done' THEN '{"type": "done", "message": "stream finished"}' ELSE '{"type": "error", "message": ' || to_json(message)::VARCHAR || '}' END
    AS event_text FROM stream_events"""))
def write_sse_events(spark, sf):
    """Written as text and read back, one row per blank-line frame."""
    path = scratch_path(spark, "sse")
    sinks.write_sse_events(sse.event_text(A.stream_events(A.answers(spark, sf))), path, "1")
    return spark.read.text(path, lineSep="\n\n").select(F.col("value").alias("event_text"))


@query(O.using("stream_events", body="""SELECT stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY index) - 1)::INTEGER AS position, type, delta,
    CASE WHEN type = 'delta' THEN index END AS index, CASE type WHEN 'done' THEN 'stream finished' WHEN 'error' THEN message END AS message FROM stream_events"""))
def read_sse_capture(spark, sf):
    """Wire text with comments in front and noise behind the end mark, parsed back."""
    captures = sse.captures_of(A.stream_events(A.answers(spark, sf)))
    noisy = F.concat(F.lit(": ping\r\n\r\n"), F.col("capture"), F.lit('data: [DONE]\n\ndata: {"type": "late"}\n\n'))
    return sse.parse_sse(captures.withColumn("capture", noisy), "stream_id")


@query(O.using("stream_events", body="""SELECT stream_id % 4 AS capture, (row_number() OVER (PARTITION BY stream_id % 4 ORDER BY stream_id, index) - 1)::INTEGER AS position, type, delta,
    CASE WHEN type = 'delta' THEN index END AS index, CASE type WHEN 'done' THEN 'stream finished' WHEN 'error' THEN message END AS message FROM stream_events"""))
def read_sse_files(spark, sf):
    """The wire text of all streams in four long captures, read back in splits.

    A capture is a folder of files in the order of their names: each task sorts and writes about ``CAPTURE_EVENTS`` events, however long the captures are.
    """
    path = scratch_path(spark, "captures")
    events = A.stream_events(A.answers(spark, sf))
    rows = sse.event_text(events).withColumn("capture", F.col("stream_id") % 4)
    # The writer ends each row with a line end: the second one of the blank line.
    text = F.substring("event_text", F.lit(1), F.char_length("event_text") - 1).alias("value")
    parts, order = max(4, -(-events.count() // CAPTURE_EVENTS)), ["capture", "stream_id", "index"]
    rows.select(*order, text).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("capture", "value").write.partitionBy("capture").text(path)
    return sse.read_sse_events(spark, path, F.regexp_extract("_metadata.file_path", r"capture=(\d+)", 1).cast("long"))


@query(O.using("thinking", body=r"""SELECT stream_id, regexp_replace(answer, '(?is)<think\b[^>]*>.*?(?:</think>|\z)', '', 'g') AS answer FROM thinking"""))
def stream_think_filter(spark, sf):
    """The stateful filter over a file stream of deltas in mixed order over three batches, joined up again per answer."""
    events = A.stream_events(A.thinking_answers(spark, sf).withColumn("session_id", F.lit(1)))
    path = scratch_path(spark, "deltas")
    events.select("stream_id", "index", "type", "delta", "ts").repartition(3, F.xxhash64("stream_id", "index")).write.parquet(path)
    source = spark.readStream.schema("stream_id long, index long, type string, delta string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    # Rows of any time come in any batch: no stream is idle, and no row late, before the whole span of times has passed.
    ends = spark.read.schema(source.schema).parquet(path).agg(F.unix_seconds(F.min("ts")).alias("a"), F.unix_seconds(F.max("ts")).alias("b")).head()
    idle = (ends["b"] or 0) - (ends["a"] or 0) + 86_400
    shown = R.run_append(W.think_filter(source, idle_seconds=idle), "think")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("index", "delta"))), lambda d: d["delta"])
    seen = shown.groupBy("stream_id").agg(F.array_join(parts, "").alias("answer"))
    every = A.answers(spark, sf).select("stream_id")
    return every.join(seen, "stream_id", "left").select("stream_id", F.coalesce("answer", F.lit("")).alias("answer"))


@query(O.using("latest_tasks", body="""SELECT task_id, state, CASE WHEN state IN ('SUCCESS', 'FAILURE', 'FAILED') THEN 100 ELSE progress END AS progress, error FROM latest_tasks"""))
def task_state_stream(spark, sf):
    path = scratch_path(spark, "task-updates")
    updates = A.task_updates(spark, sf)
    # Three files, so that the fold runs over three batches.
    updates.repartitionByRange(3, "seq").write.parquet(path)
    source = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return R.run_update(ST.task_state(source), ["task_id"], "tasks")


@query(O.using("metrics", extra=(
    ("gaps", "SELECT *, coalesce(created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) > INTERVAL 7200 SECOND, true) AS first FROM metrics"),
    ("spans", "SELECT *, sum(first::INTEGER) OVER (PARTITION BY session_id ORDER BY created_at) AS n FROM gaps")),
    body="""SELECT session_id, min(created_at) AS active_from, max(created_at) + INTERVAL 7200 SECOND AS active_until, count(*) AS requests FROM spans GROUP BY session_id, n"""))
def active_sessions_stream(spark, sf):
    """A heartbeat row a week after the last event moves the watermark past every open span."""
    path = scratch_path(spark, "activity")
    rows = A.metrics(spark, sf).select("session_id", "created_at")
    rows.write.parquet(path)
    beat = rows.agg((F.max("created_at") + F.expr("INTERVAL 7 DAYS")).alias("created_at"))
    beat.select(F.lit(None).cast("long").alias("session_id"), "created_at").write.mode("append").parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)
    spans = SM.active_sessions(source, 7200, watermark="1 day")
    return R.run_append(spans, "sessions").where(F.col("session_id").isNotNull())


@query(O.using("metrics", extra=(("seen", """SELECT DISTINCT session_id, time_bucket(INTERVAL 600 SECOND, created_at) + to_seconds(600 * k) AS pane_start
    FROM metrics, (SELECT unnest(range(12)) AS k) WHERE session_id IS NOT NULL"""),),
    body="SELECT pane_start, count(*) AS sessions, true AS estimate_near FROM seen GROUP BY pane_start"))
def active_now_stream(spark, sf):
    """Sessions active within two hours, at the end of every ten minutes; the sketch has to be within a tenth of the exact count."""
    activity = _metric_stream(spark, sf).select("session_id", "created_at")
    kept = P.drain_activity(activity, 600, scratch_path(spark, "activity"), scratch_path(spark, "activity-state"))
    near = F.abs(F.col("estimate") - F.col("sessions")) <= F.greatest(F.lit(1), F.col("sessions") / 10)
    return P.active_now(*kept, 600, 7200).select("pane_start", "sessions", near.alias("estimate_near"))


@query(O.using("metrics", body="SELECT id, request_type, created_at FROM metrics"))
def stream_to_metrics_sink(spark, sf):
    """Every row arrives twice; the sink holds it once."""
    twice = _metric_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return R.run_append(SM.deduplicated(twice, "1 hour").select("id", "request_type", "created_at"), "metrics-sink")


_PARTS = ("parts", """SELECT id, created_at, CASE WHEN created_at >= middle THEN 1 WHEN id % 10 = 0 THEN 2 ELSE 0 END AS part
  FROM metrics, (SELECT to_timestamp((epoch(min(created_at)) + epoch(max(created_at))) / 2)::TIMESTAMP AS middle FROM metrics)""")


@query(O.using("metrics", extra=(_PARTS,), body="""SELECT id, created_at, part, coalesce(created_at < (SELECT max(created_at) - INTERVAL 1 HOUR FROM parts e WHERE e.part < p.part), false) AS late FROM parts p"""))
def stream_late_rows(spark, sf):
    """Three deliveries, the last with rows of the first half: they land in the late table, all others in the windows' input."""
    rows, parts = _deliveries(A.metrics(spark, sf).select("id", "created_at"))
    path, out, state = (scratch_path(spark, n) for n in ("deliveries", "late", "late-state"))
    for part in range(3):
        parts.where(F.col("part") == part).write.mode("append").parquet(path)
        source = spark.readStream.schema(parts.schema).parquet(path)
        on_time, late = L.run_with_late_rows(source, "created_at", 3600, out, state)
    return on_time.withColumn("late", F.lit(False)).union(late.withColumn("late", F.lit(True)))


@query(O.using("chunks", body="""SELECT doc_id, chunk_index, content, 1 AS version FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 0, 'replaced ' || quality, 2 FROM labels"""))
def incremental_ingest(spark, sf):
    """All documents arrive, then the labelled ones again with a new text; the second run reads only those."""
    path = scratch_path(spark, "uploads")
    first = A.texts(spark, sf).select("doc_id", F.lit(1).alias("version"), "text")
    labels = A.table(spark, sf, "labels")
    again = labels.select(
        "doc_id", F.lit(2).alias("version"), F.concat(F.lit("replaced "), F.col("quality").cast("string")).alias("text")
    )
    out, state = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-state")
    uploads = lambda: spark.readStream.schema(first.schema).parquet(path)
    first.write.parquet(path)
    I.run_incremental_ingest(uploads(), out, state)
    again.write.mode("append").parquet(path)
    current, _ = I.run_incremental_ingest(uploads(), out, state)
    return current.select("doc_id", "chunk_index", "content", "version")


@query(O.using(extra=(REQUESTS_SQL, *scope_sql("by_ip", "ip", "requests", 3)),
    body="SELECT request_id, ip, n AS count, ok AS allowed FROM by_ip"))
def rate_limit_stream(spark, sf):
    """The keyed-state form of the address scope over the event stream."""
    e = _stream(spark, sf, "events").withColumn("ip", F.col("user_id") % 40)
    return R.run_append(SR.rate_limit_stream(SR.as_requests(e, "ip", "ts", "event_id"), "ip", DAY, 3), "rate-limit")
