"""Windowed request metrics from panes: mergeable histograms of each batch, put together into windows of any slide.

A pane is as wide as the largest step that divides window and slide, so that a row is counted in one pane and not in every window it
belongs to. Each batch adds up its rows by (pane, latency) with map-side combine and writes these partial histograms; nothing
else is kept, and histograms add up, so a window is the sum of what all batches have for its panes.

The batches carry a watermark on, as stateful operators do: the latest time of earlier batches less the delay. Rows of a pane that ends before it
are late. They are split off and marked in the same run and count in their windows, which were closed by then; ``windows`` tells how many
rows of a window came late.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R
from chunkloom.operators.metrics import PERCENTILES, chat_ok, is_chat, succeeded
from chunkloom.session import scratch_path

COUNTERS = ("total", "chat", "failed", "timed_out", "chat_ok", "no_context")
MICROS = 1_000_000
PARTIAL = "pane_start long, value long, late boolean, " + ", ".join(f"{c} long" for c in COUNTERS) + ", last_id long"


def pane_seconds(window_seconds: int, slide_seconds: int) -> int:
    return math.gcd(window_seconds, slide_seconds)


def pane_histograms(metrics: DataFrame, pane: int, watermark) -> DataFrame:
    """Rows counted by pane (its start in microseconds) and latency; null latencies count as well."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    flags = {
        "total": F.lit(1).cast("long"), "chat": flag(is_chat()), "failed": flag(~succeeded()), "timed_out": flag(F.col("timed_out")),
        "chat_ok": flag(chat_ok()), "no_context": flag(chat_ok() & F.col("no_context")),
    }
    start = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / (pane * MICROS)).cast("long") * (pane * MICROS)
    value = F.when(chat_ok(), F.col("e2e_latency_ms")).cast("long")
    counted = metrics.groupBy(start.alias("pane_start"), value.alias("value")).agg(*[F.sum(c).alias(n) for n, c in flags.items()], F.max("id").cast("long").alias("last_id"))
    ends = F.timestamp_micros(F.col("pane_start") + pane * MICROS)
    return counted.select("pane_start", "value", F.coalesce(ends <= watermark, F.lit(False)).alias("late"), *COUNTERS, "last_id")


def drain(metrics: DataFrame, pane: int, delay_seconds: int, path: str, checkpoint: str) -> DataFrame:
    """Run the stream to the end of its input; returns the partial histograms of this and all earlier runs with the same two folders.

    Every batch writes folders of its own, so a repeated batch replaces itself.
    """
    spark = metrics.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        latest = None
        if batch_id > 0:
            clock = spark.read.schema("latest timestamp").parquet(f"{path}/clock/batch={batch_id - 1}")
            latest = clock.agg(F.max("latest")).head()[0]
        before = F.lit(latest).cast("timestamp")
        # The running maximum goes from batch to batch, so only the one before is read.
        own = batch.agg(F.max("created_at").cast("timestamp").alias("latest"))
        own.select(F.greatest("latest", before).alias("latest")).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        watermark = before - F.expr(f"INTERVAL {delay_seconds} SECONDS")
        pane_histograms(batch, pane, watermark).write.mode("overwrite").parquet(f"{path}/panes/batch={batch_id}")

    metrics.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PARTIAL).option("recursiveFileLookup", "true").parquet(f"{path}/panes")


def windows(panes: DataFrame, window_seconds: int = K.METRICS_WINDOW_SECONDS, slide_seconds: int | None = None) -> DataFrame:
    """The windows that partial histograms add up to, with ``late_rows``, how many of their rows came behind the watermark."""
    slide = slide_seconds or window_seconds
    at = F.col("pane_start")
    newest = F.floor(at / (slide * MICROS)).cast("long") * (slide * MICROS)
    starts = F.sequence(newest - (window_seconds // slide) * (slide * MICROS), newest, F.lit(slide * MICROS))
    starts = F.filter(starts, lambda s: s + window_seconds * MICROS > at)
    # Equal latencies of a pane meet before they go to the windows.
    once = panes.groupBy("pane_start", "value").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last_id").alias("last_id"), F.sum(F.when(F.col("late"), F.col("total")).otherwise(0)).alias("late_rows"))
    points = F.array(*[F.lit(p / 100.0) for p in PERCENTILES.values()])
    known = F.col("value").isNotNull()
    quantiles = F.percentile("value", points, F.col("total"))
    number = {c: F.sum(c) for c in COUNTERS}
    grouped = once.withColumn("w", F.explode(starts)).groupBy("w").agg(
        number["total"].alias("total"),
        number["chat"].alias("chat"),
        F.round(F.max_by("value", F.when(known, F.col("last_id"))).cast("double"), 1).alias("e2e_last"),
        R.rounded(F.sum(F.col("value") * F.col("total")) / F.sum(F.when(known, F.col("total"))), 1).alias("e2e_avg"),
        *[R.rounded(quantiles[i], 1).alias(f"e2e_{p}") for i, p in enumerate(PERCENTILES)],
        R.ratio(number["failed"], number["total"]).alias("error_rate"),
        R.ratio(number["timed_out"], number["total"]).alias("timeout_rate"),
        R.ratio(number["no_context"], number["chat_ok"]).alias("no_context_ratio"),
        F.round(number["chat"] / F.lit(window_seconds), 3).alias("qps"),
        F.sum("late_rows").alias("late_rows"),
    )
    ends = (F.col("w"), F.col("w") + window_seconds * MICROS)
    return grouped.select(*[F.timestamp_micros(e).alias(n) for e, n in zip(ends, ("window_start", "window_end"))], "*").drop("w")


def run_windows(metrics: DataFrame, window_seconds: int, slide_seconds: int, delay_seconds: int) -> DataFrame:
    """Drain a stream once and put its windows together."""
    spark = metrics.sparkSession
    panes = drain(metrics, pane_seconds(window_seconds, slide_seconds), delay_seconds, scratch_path(spark, "panes"), scratch_path(spark, "panes-state"))
    return windows(panes, window_seconds, slide_seconds)


def drain_activity(activity: DataFrame, pane: int, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Drain a stream of (session_id, created_at): of each batch its distinct (pane, session) pairs, and a mergeable sketch for each pane."""
    spark = activity.sparkSession
    start = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / (pane * MICROS)).cast("long") * (pane * MICROS)

    def store(batch: DataFrame, batch_id: int) -> None:
        once = batch.where("session_id is not null").select(start.alias("pane_start"), F.col("session_id").cast("long").alias("session_id")).distinct()
        once.write.mode("overwrite").parquet(f"{path}/sessions/batch={batch_id}")
        sketched = once.groupBy("pane_start").agg(F.hll_sketch_agg("session_id", F.lit(12)).alias("sketch"))
        sketched.write.mode("overwrite").parquet(f"{path}/sketches/batch={batch_id}")

    activity.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    read = lambda schema, kind: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{kind}")
    return read("pane_start long, session_id long", "sessions"), read("pane_start long, sketch binary", "sketches")


def _seen_from(panes: DataFrame, pane: int, gap_seconds: int) -> DataFrame:
    """Each pane at the end of every pane that still sees it."""
    return panes.withColumn("at", F.explode(F.sequence(F.col("pane_start"), F.col("pane_start") + (gap_seconds - pane) * MICROS, F.lit(pane * MICROS))))


def active_now(sessions: DataFrame, sketches: DataFrame, pane: int, gap_seconds: int) -> DataFrame:
    """(pane_start, sessions, estimate): sessions active at the end of a pane, that is with a request in the panes of the gap up to it.

    ``sessions`` is exact and needs gap / pane rows for each session and pane; ``estimate`` is the union of as many sketches of fixed size,
    however many sessions there are. Panes in which nobody is active are left out. The gap is a multiple of the pane.
    """
    exact = _seen_from(sessions.distinct(), pane, gap_seconds).groupBy("at").agg(F.countDistinct("session_id").alias("sessions"))
    own = sketches.groupBy("pane_start").agg(F.hll_union_agg("sketch").alias("sketch"))
    union = _seen_from(own, pane, gap_seconds).groupBy("at").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return exact.join(union, "at").select(F.timestamp_micros("at").alias("pane_start"), "sessions", "estimate")
