"""Request analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.functions import records as R
from chunkloom.operators import documents as D, evaluation as V, metrics as M, rate_limit as L, tasks as K
from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query
from chunkloom.session import scratch_path
from chunkloom.sources import sinks

DAY = 86_400
CHAT, CHAT_OK, INGEST_OK = O.CHAT, O.CHAT_OK, O.INGEST_OK

_SERIES = {
    "ttft_ms": f"CASE WHEN request_type = 'chat_stream' AND status = 'success' THEN ttft_ms END::DOUBLE",
    "e2e_latency_ms": f"CASE WHEN {CHAT_OK} THEN e2e_latency_ms END::DOUBLE",
    "ingest_ready_ms": f"CASE WHEN {INGEST_OK} THEN ready_latency_ms END::DOUBLE",
    "retrieval_ms": "retrieval_ms::DOUBLE",
    "document_parse_ms": f"CASE WHEN {INGEST_OK} THEN {O.number('text_extract_ms')} END",
    "chunk_count": f"CASE WHEN {INGEST_OK} THEN {O.number('chunk_count')} END",
    "faiss_ms": O.number("faiss_ms"),
}


def _long(series: dict[str, str], source: str = "metrics") -> tuple[str, str]:
    return ("long_values", " UNION ALL ".join(f"SELECT '{n}' AS metric, id, {x} AS value FROM {source}" for n, x in series.items()))


_STATS = ", ".join(
    ["round(arg_max(value, id), 1) AS last", "round(round(avg(value), 6), 1) AS avg"]
    + [f"round(round(quantile_cont(value, {p / 100}), 6), 1) AS {n}" for n, p in M.PERCENTILES.items()]
)


def _summary_sql(series):
    return O.using("metrics", extra=(_long(series),), body=f"SELECT metric, count(*) AS samples, {_STATS} FROM long_values WHERE value IS NOT NULL GROUP BY metric")


@query(_summary_sql(_SERIES))
def latency_summary(spark, sf):
    return M.latency_summary(M.long_values(A.metrics(spark, sf), M.latency_columns()))


_EXTRA = {n: O.number(n) for n in ("faiss_ms", "text_extract_ms", "chunk_count", "recall_at_k", "mrr", "ndcg")}


@query(_summary_sql(_EXTRA))
def extra_json_summary(spark, sf):
    return M.latency_summary(M.long_values(A.metrics(spark, sf), {n: M.extra(n) for n in _EXTRA}))


_RATES = """count(*) FILTER (WHERE status <> 'success') / nullif(count(*), 0)"""
_TIMEOUTS = "count(*) FILTER (WHERE timed_out) / nullif(count(*), 0)"
_NO_CONTEXT = f"count(*) FILTER (WHERE {CHAT_OK} AND no_context) / nullif(count(*) FILTER (WHERE {CHAT_OK}), 0)"


@query(O.using("metrics", body=f"SELECT count(*) AS total, round({_RATES}, 4) AS error_rate, round({_TIMEOUTS}, 4) AS timeout_rate FROM metrics"))
def error_timeout_rates(spark, sf):
    return M.error_timeout_rates(A.metrics(spark, sf))


@query(O.using("metrics", body=f"SELECT round({_NO_CONTEXT}, 4) AS no_context_ratio FROM metrics"))
def no_context_ratio(spark, sf):
    return M.no_context_ratio(A.metrics(spark, sf))


_COSTS = f"""round(round(avg(prompt_tokens) FILTER (WHERE {CHAT_OK}), 6), 1) AS prompt_tokens_avg, coalesce(sum(prompt_tokens) FILTER (WHERE {CHAT_OK}), 0)::BIGINT AS prompt_tokens_total,
  round(round(avg(completion_tokens) FILTER (WHERE {CHAT_OK}), 6), 1) AS completion_tokens_avg, coalesce(sum(completion_tokens) FILTER (WHERE {CHAT_OK}), 0)::BIGINT AS completion_tokens_total,
  round(avg(cost_usd) FILTER (WHERE {CHAT_OK}), 8) AS cost_per_request_usd, round(avg(cost_usd) FILTER (WHERE {INGEST_OK}), 8) AS cost_per_document_usd,
  coalesce(sum(cost_usd) FILTER (WHERE {CHAT_OK}), 0)::DOUBLE AS chat_cost_total_usd, coalesce(sum(cost_usd) FILTER (WHERE {INGEST_OK}), 0)::DOUBLE AS ingest_cost_total_usd"""


@query(O.using("metrics", body=f"SELECT {_COSTS} FROM metrics"))
def token_cost_totals(spark, sf):
    return M.token_cost_totals(A.metrics(spark, sf))


@query(O.using("metrics", body=f"SELECT round(count(*) FILTER (WHERE {CHAT}) / {DAY}, 3) AS qps FROM metrics"))
def throughput_qps(spark, sf):
    return M.throughput_qps(A.metrics(spark, sf), DAY)


_WINDOW = ("recent", f"SELECT * FROM metrics WHERE created_at >= (SELECT max(ts) FROM events) - to_seconds({DAY}) ORDER BY id DESC LIMIT 5000")


def _recent(spark, sf):
    metrics = A.metrics(spark, sf)
    # One value: the moment of the report, which a caller passes in production.
    as_of = metrics.agg(F.max("created_at")).first()[0]
    return M.metrics_window_scan(metrics, F.lit(as_of), DAY)


@query(O.using("metrics", extra=(_WINDOW,), body="SELECT id, request_type, created_at FROM recent"))
def metrics_window_scan(spark, sf):
    return _recent(spark, sf).select("id", "request_type", "created_at")


_WIDE = ", ".join(
    f"round(arg_max({n}_v, id) FILTER (WHERE {n}_v IS NOT NULL), 1) AS {n}_last, round(round(avg({n}_v), 6), 1) AS {n}_avg, "
    + ", ".join(f"round(round(quantile_cont({n}_v, {p / 100}), 6), 1) AS {n}_{q}" for q, p in M.PERCENTILES.items())
    for n in _SERIES
)
_QUALITY = ", ".join(f"round(avg({O.number(n)}), 4) AS {n}_avg" for n in ("recall_at_k", "mrr", "ndcg"))


@query(O.using("metrics", "tasks", "corpus", "chunks", extra=(_WINDOW, ("wide", "SELECT *, " + ", ".join(f"{x} AS {n}_v" for n, x in _SERIES.items()) + " FROM recent")),
    body=f"""SELECT * FROM (SELECT {_WIDE}, {_COSTS}, round(count(*) FILTER (WHERE {CHAT}) / {DAY}, 3) AS qps, round({_RATES}, 4) AS error_rate,
      round({_TIMEOUTS}, 4) AS timeout_rate, round({_NO_CONTEXT}, 4) AS no_context_ratio, round(round(avg(citation_count) FILTER (WHERE {CHAT_OK}), 6), 2) AS citation_count_avg,
      count(*) AS samples_total, count(*) FILTER (WHERE {CHAT}) AS samples_chat, count(*) FILTER (WHERE request_type = 'ingest') AS samples_ingest,
      coalesce(nullif(count({O.number('recall_at_k')}), 0), nullif(count({O.number('mrr')}), 0), count({O.number('ndcg')})) AS retrieval_eval_samples, {_QUALITY},
      {DAY} AS window_seconds FROM wide),
    (SELECT pending, running, failed, pending + running AS queue_depth FROM (SELECT count(*) FILTER (WHERE state = 'PENDING') AS pending,
      count(*) FILTER (WHERE state IN ('STARTED', 'PROGRESS')) AS running, count(*) FILTER (WHERE state IN ('FAILURE', 'FAILED')) AS failed FROM tasks)),
    (SELECT count(*) AS documents_ready FROM corpus WHERE status = 'READY'), (SELECT count(*) AS total_chunks FROM chunks)"""))
def monitor_overview(spark, sf):
    return M.monitor_overview(
        _recent(spark, sf),
        K.queue_counts(A.tasks(spark, sf)),
        D.corpus_counts(A.corpus_documents(spark, sf), A.chunks(spark, sf)),
        DAY,
    )


_STAGES = ("text_extract_ms", "chunking_ms", "chunk_insert_ms", "embedding_ms", "index_ms")


@query(O.using("metrics", extra=(_long({s: f"CASE WHEN {INGEST_OK} THEN {O.number(s)} END" for s in _STAGES}),), body="""SELECT metric AS stage, count(*) AS samples,
    round(round(avg(value), 6), 1) AS avg_ms, sum(value) AS total_ms, round(sum(value) / sum(sum(value)) OVER (), 4) AS share
  FROM long_values WHERE value IS NOT NULL GROUP BY metric"""))
def timings_breakdown(spark, sf):
    return M.timings_breakdown(A.metrics(spark, sf))


@query(O.using("metrics", extra=(
    ("spans", "SELECT session_id, (request_type = 'chat_stream')::INTEGER AS s, created_at AS a, created_at + to_minutes(e2e_latency_ms) AS b FROM metrics"),
    ("edges", "SELECT session_id, ts, sum(d) AS d, sum(s) AS s FROM (SELECT session_id, a AS ts, 1 AS d, s FROM spans UNION ALL SELECT session_id, b, -1, -s FROM spans) GROUP BY ALL"),
    ("depths", "SELECT *, sum(d) OVER (PARTITION BY session_id ORDER BY ts) AS depth FROM edges"),
    ("instants", "SELECT ts, sum(CASE WHEN depth - d <= 0 AND depth > 0 THEN 1 WHEN depth - d > 0 AND depth <= 0 THEN -1 ELSE 0 END) AS d, sum(s) AS s FROM depths GROUP BY ts"),
    ("running", "SELECT ts, sum(d) OVER (ORDER BY ts) AS sessions, sum(s) OVER (ORDER BY ts) AS streams FROM instants")),
    body="SELECT ts::DATE AS day, max(sessions)::BIGINT AS peak_sessions, max(streams)::BIGINT AS peak_streams FROM running GROUP BY 1"))
def concurrent_sessions(spark, sf):
    return M.concurrent_sessions(A.activity_intervals(spark, sf))


@query("""SELECT ts, value, round(greatest(8.0, value / greatest(1.0, max(value) OVER ()) * 100), 4) AS height
  FROM (SELECT ts, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events ORDER BY ts DESC LIMIT 18)""")
def last_18_points(spark, sf):
    gauge = F.when(F.col("event_type") != "error", F.col("value"))
    samples = A.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), gauge.alias("gauge"))
    return M.gauge_points(samples, "gauge")


@query(O.using("metrics", body="SELECT id, error_message, coalesce(error_message LIKE '%timed out%' OR error_message LIKE '%timeout%', false) AS timed_out FROM metrics"))
def classify_timeout(spark, sf):
    return A.metrics(spark, sf).select("id", "error_message", R.is_timeout(F.col("error_message")).alias("timed_out"))


@query(O.using("load_results", body="SELECT id, mode, success, CASE WHEN mode = 'stream' THEN ttft_ms END AS ttft_ms FROM load_results"))
def union_run_results(spark, sf):
    runs = A.load_results(spark, sf)
    asynchronous = runs.where(F.col("mode") == "async").select("id", "mode", "success")
    streams = runs.where(F.col("mode") == "stream").select("id", "mode", "success", "ttft_ms")
    return M.union_run_results(asynchronous, streams)


_RUN = {
    "ttft_ms": "CASE WHEN success AND mode = 'stream' THEN coalesce(nullif(server_ttft_ms, 0), ttft_ms) END",
    "e2e_latency_ms": "CASE WHEN success THEN coalesce(nullif(server_e2e_ms, 0), client_e2e_ms) END",
    "retrieval_ms": "CASE WHEN success THEN retrieval_ms END::DOUBLE",
}
_RUN_STATS = ", ".join(
    ", ".join([f"round(round(quantile_cont({x}, {p / 100}), 6), 2) AS {n}_{q}" for q, p in M.PERCENTILES.items()] + [f"round(round(avg({x}), 6), 2) AS {n}_avg"])
    for n, x in _RUN.items()
)


@query(O.using("load_results", body=f"""SELECT {_RUN_STATS}, round(round(avg(prompt_tokens) FILTER (WHERE success), 6), 2) AS prompt_tokens_avg,
    round(round(avg(completion_tokens) FILTER (WHERE success), 6), 2) AS completion_tokens_avg, round(round(avg(citation_count) FILTER (WHERE success), 6), 2) AS citation_count_avg,
    round(avg(cost_usd) FILTER (WHERE success), 8) AS cost_per_request_usd, round(count(*) FILTER (WHERE NOT success) / count(*), 4) AS error_rate,
    round(count(*) FILTER (WHERE timed_out) / count(*), 4) AS timeout_rate,
    round(count(*) FILTER (WHERE success AND no_context) / count(*) FILTER (WHERE success), 4) AS no_context_ratio,
    round(count(*) FILTER (WHERE success) / 1800.0, 3) AS qps, count(*) FILTER (WHERE mode = 'async') AS async_requests,
    count(*) FILTER (WHERE mode = 'stream') AS stream_requests, count(*) FILTER (WHERE success) AS successful_requests FROM load_results"""))
def load_test_report(spark, sf):
    return M.load_test_report(A.load_results(spark, sf), 1800.0)


@query(O.using("metrics", body="""SELECT id, (id % 17 = 0)::INTEGER AS no_context, timed_out::INTEGER AS timed_out,
    '{"faiss_ms":' || e2e_latency_ms || ',"note":' || CASE WHEN id % 3 > 0 THEN '"' || status || '"' ELSE 'null' END || '}' AS extra_json, created_at::DATE AS created_day FROM metrics"""))
def append_request_metrics(spark, sf):
    records = A.metrics(spark, sf).withColumns({"faiss_ms": F.col("e2e_latency_ms"), "note": F.when(F.col("id") % 3 > 0, F.col("status"))}).drop("extra_json")
    path = scratch_path(spark, "request-metrics")
    for _ in range(2):  # the second time is a retry
        sinks.append_request_metrics(sinks.metric_rows(records, ["faiss_ms", "note"]), path, "1")
    return spark.read.parquet(path).select("id", "no_context", "timed_out", "extra_json", "created_day")


def _chain_sql(key: str, source: str) -> str:
    """Window starts of every key, each the first request after the window before."""
    return f"""SELECT k, s FROM (SELECT {key} AS k, min(ts) AS s FROM {source} GROUP BY 1)
  UNION ALL SELECT c.k, (SELECT min(r.ts) FROM {source} r WHERE r.{key} = c.k AND r.ts >= c.s + to_seconds({DAY})) FROM {{name}} c WHERE c.s IS NOT NULL"""


def scope_sql(name: str, key: str, source: str, limit: int) -> tuple[tuple[str, str], ...]:
    chain = f"{name}_chain"
    return (
        (chain, _chain_sql(key, source).format(name=chain)),
        (
            name,
            f"""SELECT *, n <= {limit} AS ok, greatest(0, {limit} - n) AS remaining, floor(epoch(ts))::BIGINT + {DAY} AS reset_epoch FROM (
    SELECT r.*, row_number() OVER (PARTITION BY r.{key}, c.s ORDER BY r.ts, r.request_id) AS n
    FROM {source} r ASOF JOIN (SELECT * FROM {chain} WHERE s IS NOT NULL) c ON r.{key} = c.k AND r.ts >= c.s)""",
        ),
    )


REQUESTS_SQL = ("requests", 'SELECT event_id AS request_id, user_id % 40 AS ip, user_id AS "user", ts FROM events')


@query(O.using(extra=(
    REQUESTS_SQL,
    *scope_sql("by_ip", "ip", "requests", 3),
    ("passed", 'SELECT request_id, ip, "user", ts FROM by_ip WHERE ok'),
    *scope_sql("by_user", '"user"', "passed", 2)),
    body="""SELECT i.request_id, i.n AS ip_count, i.ok AS ip_allowed, i.remaining AS ip_remaining, i.reset_epoch AS ip_reset_epoch,
    u.n AS user_count, u.ok AS user_allowed, i.ok AND coalesce(u.ok, true) AS allowed FROM by_ip i LEFT JOIN by_user u USING (request_id)"""))
def rate_limit_fixed_window(spark, sf):
    out = L.chained_limits(A.rate_requests(spark, sf), DAY, ip_limit=3, user_limit=2)
    return out.select(
        "request_id", "ip_count", "ip_allowed", "ip_remaining", "ip_reset_epoch", "user_count", "user_allowed", "allowed"
    )


@query(O.using("metrics", body=f"""SELECT coalesce(nullif(count({_EXTRA['recall_at_k']}), 0), nullif(count({_EXTRA['mrr']}), 0), count({_EXTRA['ndcg']})) AS retrieval_eval_samples,
  {_QUALITY} FROM metrics"""))
def retrieval_eval_samples(spark, sf):
    """The macro averages read back from the metrics table."""
    return V.retrieval_eval_macro(M.extra_eval_values(A.metrics(spark, sf)))
