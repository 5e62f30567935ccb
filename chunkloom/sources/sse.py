"""Server-sent event text to rows and back. One capture is the stream of one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.operators.ranking import running_totals
from chunkloom.session import written

END_MARK = "[DONE]"
EVENT_SCHEMA = "type string, delta string, index long, message string"


def event_payloads(capture: Column) -> Column:
    """Data payloads in order: blank-line framing, comments skipped, data lines joined, stop at the end mark."""
    text = F.regexp_replace(capture, r"\r\n?", "\n")
    is_data = lambda line: F.startswith(line, F.lit("data:"))
    value = lambda line: F.regexp_replace(F.substring(line, 6, 2**31 - 1), r"^\s+", "")

    def payload(event: Column) -> Column:
        lines = F.filter(F.split(event, "\n"), is_data)
        return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, value), "\n"))

    found = F.array_compact(F.transform(F.split(text, r"\n{2,}"), payload))
    end = F.array_position(found, END_MARK)
    return F.when(end > 0, F.slice(found, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(found)


def parse_sse(captures: DataFrame, key: str, capture: str = "capture") -> DataFrame:
    """(key, capture) to one row per event: position, type, delta, index, message."""
    rows = captures.select(key, F.posexplode(event_payloads(F.col(capture))).alias("position", "payload"))
    parsed = rows.withColumn("e", F.from_json("payload", EVENT_SCHEMA))
    return parsed.select(key, F.col("position"), "e.type", "e.delta", F.col("e.index").alias("index"), "e.message")


def read_sse_events(spark: SparkSession, path: str, capture: Column | None = None) -> DataFrame:
    """(capture, position, type, delta, index, message) of capture files below a path; ``capture`` is the file.

    With another ``capture``, an expression over ``_metadata``, its files are one text in the order of their names. A file is read line by line in splits, so that a long capture is many tasks, and no capture is ever one value. Lines keep
    the order of their split and their place in it; blank lines are counted along that order, by split first and then inside the
    splits, which tells the frame of each line however a frame lies across two splits. Frames behind the end mark are left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    data = F.startswith("value", F.lit("data:"))
    # A split lies in one task, so the running number of the rows orders its lines.
    lines = lines.select(
        (F.col("_metadata.file_path") if capture is None else capture).alias("capture"),
        F.struct("_metadata.file_name", "_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value",
    ).where(data | (F.col("value") == ""))
    lines = written(lines, "sse-lines", compression="zstd")
    framed = running_totals(lines, ["capture"], F.col("_split"), [F.col("_at")], {"_frame": (F.col("value") == "").cast("long")}).where(data)
    value = F.regexp_replace(F.substring("value", 6, 2**31 - 1), r"^\s+", "").alias("value")
    item = F.struct("_split", "_at", value)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda line: line["value"]), "\n")
    frames = framed.groupBy("capture", "_frame").agg(joined.alias("payload"))
    ends = frames.where(F.col("payload") == END_MARK).groupBy("capture").agg(F.min("_frame").alias("_end"))
    kept = frames.join(ends, "capture", "left").where(F.col("_end").isNull() | (F.col("_frame") < F.col("_end"))).drop("_end")
    counted = running_totals(kept, ["capture"], F.floor(F.col("_frame") / 4096), [F.col("_frame")], {"_n": F.lit(1).cast("long")})
    parsed = counted.withColumn("e", F.from_json("payload", EVENT_SCHEMA))
    return parsed.select("capture", (F.col("_n") - 1).cast("int").alias("position"), "e.type", "e.delta", F.col("e.index").alias("index"), "e.message")


def json_text(value: Column) -> Column:
    """A JSON string literal."""
    boxed = F.to_json(F.array(value))
    return F.substring(boxed, F.lit(2), F.char_length(boxed) - 2)


def sse_event(payload: Column, event: str | None = None) -> Column:
    head = F.lit(f"event: {event}\ndata: ") if event else F.lit("data: ")
    return F.concat(head, payload, F.lit("\n\n"))


def delta_event(delta: Column, index: Column) -> Column:
    payload = F.concat(
        F.lit('{"type": "delta", "delta": '), json_text(delta), F.lit(', "index": '), index.cast("string"), F.lit("}")
    )
    return sse_event(payload)


def done_event() -> Column:
    return sse_event(F.lit('{"type": "done", "message": "stream finished"}'))


def error_event(message: Column) -> Column:
    return sse_event(F.concat(F.lit('{"type": "error", "message": '), json_text(message), F.lit("}")))


def event_text(events: DataFrame) -> DataFrame:
    """Stream events (stream_id, index, type, delta, message) with their wire text."""
    kind = F.col("type")
    text = (
        F.when(kind == "delta", delta_event(F.col("delta"), F.col("index")))
        .when(kind == "done", done_event())
        .otherwise(error_event(F.col("message")))
    )
    return events.withColumn("event_text", text)


def captures_of(events: DataFrame) -> DataFrame:
    """Whole wire text per stream, events in index order."""
    item = F.struct("index", "event_text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["event_text"]), "")
    return event_text(events).groupBy("stream_id").agg(joined.alias("capture"))
