"""Request analytics over the append-only metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T
from chunkloom.operators.evaluation import macro_columns
from chunkloom.operators.ranking import exact_percentiles, one_row, running_totals, value_counts
from chunkloom.session import written

CHAT_TYPES = ("chat_async", "chat_stream")
PERCENTILES = {"p50": 50, "p95": 95, "p99": 99}


def is_chat() -> Column:
    return F.col("request_type").isin(*CHAT_TYPES)


def succeeded() -> Column:
    return F.col("status") == "success"


def chat_ok() -> Column:
    return is_chat() & succeeded()


def ingest_ok() -> Column:
    return (F.col("request_type") == "ingest") & succeeded()


def extra(field: str) -> Column:
    return R.json_number(F.col("extra_json"), field)


def latency_columns() -> dict[str, Column]:
    """The summarised series, each null where a row does not count for it."""
    stream_ok = (F.col("request_type") == "chat_stream") & succeeded()
    return {
        "ttft_ms": F.when(stream_ok, F.col("ttft_ms").cast("double")),
        "e2e_latency_ms": F.when(chat_ok(), F.col("e2e_latency_ms").cast("double")),
        "ingest_ready_ms": F.when(ingest_ok(), F.col("ready_latency_ms").cast("double")),
        "retrieval_ms": F.col("retrieval_ms").cast("double"),
        "document_parse_ms": F.when(ingest_ok(), extra("text_extract_ms")),
        "chunk_count": F.when(ingest_ok(), extra("chunk_count")),
        "faiss_ms": extra("faiss_ms"),
    }


def metrics_window_scan(
    metrics: DataFrame, as_of: Column, window_seconds: int = K.METRICS_WINDOW_SECONDS, limit: int = K.METRICS_MAX_ROWS
) -> DataFrame:
    """Rows of the last ``window_seconds`` before ``as_of``, the newest ``limit`` by id."""
    since = as_of - F.expr(f"INTERVAL '{window_seconds}' SECOND")
    return metrics.where(F.col("created_at") >= since).orderBy(F.desc("id")).limit(limit)


def long_values(metrics: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(metric, id, value) of all non-null readings, in one pass over the rows."""
    items = F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in columns.items()])
    return (
        metrics.select("id", F.explode(items).alias("r"))
        .select("r.metric", "id", "r.value")
        .where(F.col("value").isNotNull())
    )


def weighted_mean() -> Column:
    """Mean of counted values."""
    return F.sum(F.col("value") * F.col("_c")) / F.sum("_c")


def latency_summary(values: DataFrame, digits: int = 1) -> DataFrame:
    """last, avg, p50, p95, p99 per metric of (metric, id, value)."""
    counts = value_counts(values, ["metric"], F.max("id").alias("_id"))
    base = counts.groupBy("metric").agg(
        F.sum("_c").alias("samples"), F.max_by("value", "_id").alias("last"), weighted_mean().alias("avg")
    )
    joined = base.join(exact_percentiles(counts, ["metric"], PERCENTILES), "metric")
    return joined.select(
        "metric", "samples", *[R.rounded(F.col(c), digits).alias(c) for c in ("last", "avg", "p50", "p95", "p99")]
    )


def error_timeout_rates(metrics: DataFrame) -> DataFrame:
    total = F.count("*")
    return metrics.agg(
        total.alias("total"),
        R.ratio(F.count_if(~succeeded()), total).alias("error_rate"),
        R.ratio(F.count_if("timed_out"), total).alias("timeout_rate"),
    )


def no_context_ratio(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        R.ratio(F.count_if(chat_ok() & F.col("no_context")), F.count_if(chat_ok())).alias("no_context_ratio")
    )


def _cost_columns() -> list[Column]:
    chat = lambda c: F.when(chat_ok(), F.col(c))
    ingest_cost = F.when(ingest_ok(), F.col("cost_usd"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    money = lambda c: F.round(c.cast("double"), 8)
    return [
        R.rounded(F.avg(chat("prompt_tokens")), 1).alias("prompt_tokens_avg"),
        total(chat("prompt_tokens")).cast("long").alias("prompt_tokens_total"),
        R.rounded(F.avg(chat("completion_tokens")), 1).alias("completion_tokens_avg"),
        total(chat("completion_tokens")).cast("long").alias("completion_tokens_total"),
        money(F.avg(chat("cost_usd"))).alias("cost_per_request_usd"),
        money(F.avg(ingest_cost)).alias("cost_per_document_usd"),
        money(total(chat("cost_usd"))).alias("chat_cost_total_usd"),
        money(total(ingest_cost)).alias("ingest_cost_total_usd"),
    ]


def token_cost_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*_cost_columns())


def throughput_qps(metrics: DataFrame, window_seconds: int) -> DataFrame:
    rate = F.count_if(is_chat()) / F.lit(max(1, window_seconds))
    return metrics.agg(F.round(rate, 3).alias("qps"))


def extra_eval_values(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[extra(c).alias(c) for c in ("recall_at_k", "mrr", "ndcg")])


def usage_metrics(answers: DataFrame) -> DataFrame:
    """Provider token counts from ``usage_json`` or estimates from ``prompt_estimate`` and ``answer_text``."""
    member = lambda name: R.safe_int(F.get_json_object("usage_json", f"$.{name}"))
    prompt = F.coalesce(member("prompt_tokens"), member("input_tokens"))
    completion = F.coalesce(member("completion_tokens"), member("output_tokens"))
    estimated = prompt.isNull() | completion.isNull()
    full = answers.withColumns(
        {
            "prompt_tokens": F.coalesce(prompt, F.col("prompt_estimate").cast("long")),
            "completion_tokens": F.coalesce(completion, T.estimate_tokens(F.col("answer_text")).cast("long")),
            "token_source": F.when(estimated, F.lit("estimated")).otherwise(F.lit("provider")),
        }
    )
    both = F.col("prompt_tokens") + F.col("completion_tokens")
    return full.withColumn("total_tokens", F.coalesce(member("total_tokens"), both))


def chat_cost(
    answers: DataFrame, prompt_price: float, completion_price: float, embedding_price: float
) -> DataFrame:
    """Cost of each answer; only answers of the model cost anything."""
    paid = F.col("answer_source") == "llm"
    tokens = lambda c: F.when(paid, F.col(c)).otherwise(F.lit(0))
    total = (
        R.token_cost(tokens("prompt_tokens"), prompt_price)
        + R.token_cost(tokens("completion_tokens"), completion_price)
        + R.token_cost(tokens("query_tokens"), embedding_price)
    )
    return answers.withColumn("cost_usd", F.round(total, 8))


def monitor_overview(window: DataFrame, queue: DataFrame, corpus: DataFrame, window_seconds: int) -> DataFrame:
    """All dashboard blocks in one row. ``window`` is the row-capped scan, so built-in percentiles are safe."""
    columns: list[Column] = []
    points = F.array(*[F.lit(p / 100.0) for p in PERCENTILES.values()])
    series = latency_columns()
    quality = {c: extra(c) for c in ("recall_at_k", "mrr", "ndcg")}
    rows = window.withColumns({**{f"_{n}": c for n, c in series.items()}, **quality})
    for name in series:
        value = F.col(f"_{name}")
        last = F.max_by(value, F.when(value.isNotNull(), F.col("id")))
        quantiles = F.percentile(value, points)
        columns += [F.round(last, 1).alias(f"{name}_last"), R.rounded(F.avg(value), 1).alias(f"{name}_avg")]
        columns += [R.rounded(quantiles[i], 1).alias(f"{name}_{p}") for i, p in enumerate(PERCENTILES)]
    total = F.count("*")
    chat = F.count_if(is_chat())
    summary = rows.agg(
        *columns,
        *_cost_columns(),
        F.round(chat / F.lit(max(1, window_seconds)), 3).alias("qps"),
        R.ratio(F.count_if(~succeeded()), total).alias("error_rate"),
        R.ratio(F.count_if("timed_out"), total).alias("timeout_rate"),
        R.ratio(F.count_if(chat_ok() & F.col("no_context")), F.count_if(chat_ok())).alias("no_context_ratio"),
        R.rounded(F.avg(F.when(chat_ok(), F.col("citation_count"))), 2).alias("citation_count_avg"),
        total.alias("samples_total"),
        chat.alias("samples_chat"),
        F.count_if(F.col("request_type") == "ingest").alias("samples_ingest"),
        *macro_columns(),
    )
    return one_row(summary, queue, corpus).withColumn("window_seconds", F.lit(window_seconds))


def timings_breakdown(metrics: DataFrame, stages=K.INGEST_TIMINGS) -> DataFrame:
    """Mean and share of each ingest stage from the extra JSON."""
    rows = metrics.where(ingest_ok())
    values = long_values(rows, {s: extra(s) for s in stages})
    per_stage = values.groupBy(F.col("metric").alias("stage")).agg(
        F.count("*").alias("samples"), R.rounded(F.avg("value"), 1).alias("avg_ms"), F.sum("value").alias("total_ms")
    )
    # One row per stage is left, so a window over all of them is small.
    all_stages = F.sum("total_ms").over(Window.partitionBy(F.lit(0)))
    return per_stage.select("stage", "samples", "avg_ms", "total_ms", R.ratio(F.col("total_ms"), all_stages).alias("share"))


def concurrency_by_instant(intervals: DataFrame) -> DataFrame:
    """Active sessions and streams after each instant of (session_id, is_stream, started_at, ended_at).

    A session is active while any of its requests runs. Both running sums are cut into hours.
    """
    hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000))
    stream = F.col("is_stream").cast("long")
    edge = lambda ts, sign: F.struct(F.col(ts).alias("ts"), F.lit(sign).alias("d"), (stream * sign).alias("s"))
    edges = intervals.select("session_id", F.explode(F.array(edge("started_at", 1), edge("ended_at", -1))).alias("e"))
    per_session = edges.groupBy("session_id", "e.ts").agg(F.sum("e.d").alias("d"), F.sum("e.s").alias("s"))
    # A running sum reads its input twice, so both inputs are stored.
    per_session = written(per_session, "session-edges")
    depth = running_totals(per_session, ["session_id"], hour, [F.col("ts")], {"depth": F.col("d")})
    before = F.col("depth") - F.col("d")
    change = F.when((before <= 0) & (F.col("depth") > 0), 1).when((before > 0) & (F.col("depth") <= 0), -1).otherwise(0)
    instants = written(depth.groupBy("ts").agg(F.sum(change).alias("d"), F.sum("s").alias("s")), "instants")
    return running_totals(
        instants, [], hour, [F.col("ts")], {"sessions": F.col("d"), "streams": F.col("s")}
    ).select("ts", "sessions", "streams")


def concurrent_sessions(intervals: DataFrame) -> DataFrame:
    """Daily peaks of active sessions and stream connections."""
    return concurrency_by_instant(intervals).groupBy(F.to_date("ts").alias("day")).agg(
        F.max("sessions").alias("peak_sessions"), F.max("streams").alias("peak_streams")
    )


def gauge_points(samples: DataFrame, value: str, keep: int = K.GAUGE_POINTS) -> DataFrame:
    """Newest ``keep`` points of (ts, value) with nulls as 0 and bar heights in percent, at least 8."""
    newest = samples.orderBy(F.desc("ts")).limit(keep).withColumn("value", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    top = F.greatest(F.lit(1.0), F.max("value").over(Window.partitionBy(F.lit(0))))
    height = F.greatest(F.lit(8.0), F.col("value") / top * 100)
    return newest.select("ts", "value", F.round(height, 4).alias("height"))


def union_run_results(*runs: DataFrame) -> DataFrame:
    """All result rows; columns missing in one run are null."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def load_test_report(results: DataFrame, phase_seconds: float) -> DataFrame:
    """One row of figures over load-run results. A server value of 0 counts as absent next to a client value."""
    ok = F.col("success")
    either = lambda server, client: F.coalesce(F.nullif(F.col(server), F.lit(0.0)), F.col(client))
    series = {
        "ttft_ms": F.when(ok & (F.col("mode") == "stream"), either("server_ttft_ms", "ttft_ms")),
        "e2e_latency_ms": F.when(ok, either("server_e2e_ms", "client_e2e_ms")),
        "retrieval_ms": F.when(ok, F.col("retrieval_ms").cast("double")),
    }
    counts = value_counts(long_values(results, series), ["metric"])
    summary = exact_percentiles(counts, ["metric"], PERCENTILES).join(
        counts.groupBy("metric").agg(weighted_mean().alias("avg")), "metric"
    )
    stats = [*PERCENTILES, "avg"]
    wide = summary.agg(
        *[
            R.rounded(F.max(F.when(F.col("metric") == m, F.col(s))), 2).alias(f"{m}_{s}")
            for m in series
            for s in stats
        ]
    )
    good = lambda c: F.when(ok, F.col(c))
    total = F.count("*")
    rates = results.agg(
        R.rounded(F.avg(good("prompt_tokens")), 2).alias("prompt_tokens_avg"),
        R.rounded(F.avg(good("completion_tokens")), 2).alias("completion_tokens_avg"),
        R.rounded(F.avg(good("citation_count")), 2).alias("citation_count_avg"),
        F.round(F.avg(good("cost_usd")).cast("double"), 8).alias("cost_per_request_usd"),
        R.ratio(F.count_if(~ok), total).alias("error_rate"),
        R.ratio(F.count_if("timed_out"), total).alias("timeout_rate"),
        R.ratio(F.count_if(ok & F.col("no_context")), F.count_if(ok)).alias("no_context_ratio"),
        F.round(F.count_if(ok) / F.lit(float(phase_seconds)), 3).alias("qps") if phase_seconds > 0 else F.lit(0.0).alias("qps"),
        F.count_if(F.col("mode") == "async").alias("async_requests"),
        F.count_if(F.col("mode") == "stream").alias("stream_requests"),
        F.count_if(ok).alias("successful_requests"),
    )
    return one_row(wide, rates)
