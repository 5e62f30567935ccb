"""Windowed request metrics, active sessions and the metrics sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R
from chunkloom.operators.metrics import PERCENTILES, chat_ok, is_chat, succeeded


def windowed_metrics(
    metrics: DataFrame,
    window_seconds: int = K.METRICS_WINDOW_SECONDS,
    slide_seconds: int | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Latency and rates per event-time window; the same plan runs on a batch or a stream.

    Latencies are whole milliseconds, so the exact percentile keeps one counter per
    distinct millisecond of a window, not the readings themselves.
    """
    if watermark:
        metrics = metrics.withWatermark("created_at", watermark)
    size = f"{window_seconds} seconds"
    slot = F.window("created_at", size, f"{slide_seconds} seconds" if slide_seconds else size)
    e2e = F.when(chat_ok(), F.col("e2e_latency_ms"))
    quantiles = F.percentile(e2e, F.array(*[F.lit(p / 100.0) for p in PERCENTILES.values()]))
    total = F.count("*")
    grouped = metrics.groupBy(slot.alias("w")).agg(
        total.alias("total"),
        F.count_if(is_chat()).alias("chat"),
        F.round(F.max_by(e2e, F.when(e2e.isNotNull(), F.col("id"))).cast("double"), 1).alias("e2e_last"),
        R.rounded(F.avg(e2e), 1).alias("e2e_avg"),
        *[R.rounded(quantiles[i], 1).alias(f"e2e_{p}") for i, p in enumerate(PERCENTILES)],
        R.ratio(F.count_if(~succeeded()), total).alias("error_rate"),
        R.ratio(F.count_if("timed_out"), total).alias("timeout_rate"),
        R.ratio(F.count_if(chat_ok() & F.col("no_context")), F.count_if(chat_ok())).alias("no_context_ratio"),
        F.round(F.count_if(is_chat()) / F.lit(window_seconds), 3).alias("qps"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def active_sessions(metrics: DataFrame, gap_seconds: int, watermark: str | None = None) -> DataFrame:
    """Activity spans of each session: requests closer than the gap belong together."""
    if watermark:
        metrics = metrics.withWatermark("created_at", watermark)
    span = F.session_window("created_at", f"{gap_seconds} seconds")
    grouped = metrics.groupBy(span.alias("w"), "session_id").agg(F.count("*").alias("requests"))
    return grouped.select(
        "session_id", F.col("w.start").alias("active_from"), F.col("w.end").alias("active_until"), "requests"
    )


def deduplicated(metrics: DataFrame, watermark: str, key: str = "id") -> DataFrame:
    """Rows of a stream with repeated ids dropped inside the watermark."""
    return metrics.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark([key])
