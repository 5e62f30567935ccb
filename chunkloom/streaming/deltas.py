"""Answer streams: splitting, reassembly, timing and the incremental think-tag filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkloom import constants as K
from chunkloom.functions import text as T

THINK_BLOCK = re.compile(r"<think\b[^>]*>.*?</think>", re.IGNORECASE | re.DOTALL)
UNCLOSED = re.compile(r"<think\b[^>]*>.*\Z", re.IGNORECASE | re.DOTALL)
# The end of a text that may still grow into an opening tag when the next delta arrives.
OPENING = re.compile(r"<(?:t(?:h(?:i(?:n(?:k(?:[^\w>][^>]*)?)?)?)?)?)?\Z", re.IGNORECASE)
CLOSE_LENGTH = len("</think>")


def split_deltas(answers: DataFrame, size: int = K.STREAM_DELTA_CHARS) -> DataFrame:
    """(stream_id, answer) to fixed pieces numbered from 1."""
    rows = answers.select("stream_id", F.posexplode(T.fixed_pieces(F.col("answer"), size)))
    return rows.select("stream_id", (F.col("pos") + 1).cast("long").alias("index"), F.col("col").alias("delta"))


def reassemble(events: DataFrame) -> DataFrame:
    """Answer per stream; without a done event, or with an error event, the stream is an error."""
    delta = F.when(F.col("type") == "delta", F.struct("index", "delta"))
    parts = F.transform(F.array_sort(F.collect_list(delta)), lambda d: d["delta"])
    grouped = events.groupBy("stream_id").agg(
        F.array_join(parts, "").alias("answer"),
        F.bool_or(F.col("type") == "done").alias("_done"),
        F.min_by("message", F.when(F.col("type") == "error", F.col("index"))).alias("_message"),
        F.bool_or(F.col("type") == "error").alias("_error"),
    )
    error = F.when(F.col("_error"), F.coalesce("_message", F.lit("stream error"))).when(
        ~F.col("_done"), F.lit("stream closed before done event")
    )
    return grouped.select("stream_id", "answer", error.alias("error"))


def stream_timing(events: DataFrame) -> DataFrame:
    """Milliseconds from the request to the first delta and to the end."""
    millis = lambda kind: F.unix_millis(F.min(F.when(F.col("type") == kind, F.col("ts")))) - F.unix_millis(F.min("requested_at"))
    return events.groupBy("stream_id").agg(millis("delta").alias("ttft_ms"), millis("done").alias("e2e_ms"))


def feed(held: str, delta: str) -> tuple[str, str]:
    """Visible text after one more delta, and what is held back for the next."""
    text = held + delta
    end = 0
    for block in THINK_BLOCK.finditer(text):
        end = block.end()
    shown, rest = THINK_BLOCK.sub("", text[:end]), text[end:]
    unclosed = UNCLOSED.search(rest)
    if unclosed:
        # Of the hidden text only a started closing tag matters.
        return shown + rest[: unclosed.start()], "<think>" + rest[unclosed.start() :].partition(">")[2][-CLOSE_LENGTH:]
    opening = OPENING.search(rest)
    cut = opening.start() if opening else len(rest)
    return shown + rest[:cut], rest[cut:]


def release(held: str) -> str:
    """What the end of a stream still shows."""
    return "" if UNCLOSED.search(held) else held


def think_filter(events: DataFrame, idle_seconds: int = K.STREAM_IDLE_SECONDS) -> DataFrame:
    """Stateful filter over a stream of (stream_id, index, type, delta, ts); blank results are not emitted.

    Deltas may come in any order and over any batches: what comes before its turn waits in the state, and an index that has been seen
    is dropped. The done event releases a held-back prefix, unless it sits inside a think tag, and ends the state. A
    stream that says nothing for ``idle_seconds`` of event time is closed as well: what still waits is taken in its order, gaps left out.
    Rows older than the watermark (the latest time less ``idle_seconds``) are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, following, latest, waiting = "", 1, 0, {}
        if state.exists:
            held, following, latest, indexes, kinds, texts = state.get
            waiting = {i: (k, t) for i, k, t in zip(indexes, kinds, texts)}
        closing = state.hasTimedOut
        if not closing:
            for rows in batches:
                for index, kind, delta, at in zip(rows["index"], rows["type"], rows["delta"], rows["ts"]):
                    latest = max(latest, int(at.timestamp() * 1000))
                    if index >= following:
                        waiting.setdefault(int(index), (kind, delta))
        out, finished = [], False
        while waiting and not finished and (closing or following in waiting):
            following = min(waiting) if closing else following
            kind, delta = waiting.pop(following)
            if kind == "delta":
                shown, held = feed(held, delta or "")
            else:
                shown, held, finished = release(held), "", True
            if shown:
                out.append((key[0], following, shown))
            following += 1
        if closing and not finished and (shown := release(held)):
            out.append((key[0], following, shown))
        if closing or finished:
            state.remove()
        else:
            order = sorted(waiting)
            state.update((held, following, latest, order, [waiting[i][0] for i in order], [waiting[i][1] for i in order]))
            # Never behind the watermark, which the state would refuse.
            state.setTimeoutTimestamp(max(latest + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["stream_id", "index", "delta"])

    watched = events.withWatermark("ts", f"{idle_seconds} seconds")
    return watched.groupBy("stream_id").applyInPandasWithState(
        step,
        "stream_id long, index long, delta string",
        "held string, following long, latest long, indexes array<long>, kinds array<string>, texts array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
