"""Logical tables of the operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.constants import STAGE_PROGRESS
from chunkloom.functions.text import fixed_pieces
from chunkloom.operators.chunks import chunk_documents, with_chunk_id
from chunkloom.sources.files import spread

VECTORS_PER_DOC = 50
MODEL = "m1"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def choose(number: Column, *values) -> Column:
    """The value at position ``number``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def instant(seconds: Column) -> Column:
    """2024-01-01 UTC plus seconds."""
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def corpus_documents(spark, sf) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    i = F.col("doc_id")
    ext = choose(i % 8, ".md", ".txt", ".JSON", ".csv", ".pdf", ".docx", ".exe", "")
    status = choose(i % 10, "FAILED", "INGESTING", "UPLOADED", *["READY"] * 7)
    return d.select(
        i.alias("id"),
        (i % 50).alias("user_id"),
        F.concat(F.lit("d:"), i.cast("string"), ext).alias("filename"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        status.alias("status"),
        F.col("text"),
    )


def texts(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def chunks(spark, sf) -> DataFrame:
    return with_chunk_id(chunk_documents(texts(spark, sf)))


def vectors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.alias("chunk_id"),
        F.floor(i / VECTORS_PER_DOC).cast("long").alias("doc_id"),
        (i % VECTORS_PER_DOC).cast("int").alias("chunk_index"),
        "embedding",
        "label",
    )


def vector_contents(spark, sf) -> DataFrame:
    """Whole document texts as chunk contents."""
    d = texts(spark, sf).withColumnRenamed("doc_id", "chunk_id")
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return ids.join(d, "chunk_id", "left").select("chunk_id", F.coalesce("text", F.lit("empty")).alias("content"))


def queries(spark, sf) -> DataFrame:
    """Every vector asks its own document; the benchmark texts are dealt out as questions."""
    ids = vectors(spark, sf).select(F.col("chunk_id").alias("query_id"), "doc_id", "embedding", "label")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("question"))
    return ids.withColumn("_item", F.col("query_id") % b.count()).join(b, "_item").drop("_item")


def relevance(spark, sf) -> DataFrame:
    """Chunks with the query's label, and every seventh chunk index of its document."""
    v = vectors(spark, sf).select("chunk_id", "doc_id", "label")
    q = v.select(F.col("chunk_id").alias("query_id"), "doc_id", "label")
    by_id = q.join(v, ["doc_id", "label"]).select(
        "query_id", F.lit("id").alias("label_kind"), F.col("chunk_id").alias("value")
    )
    steps = F.sequence(F.lit(0), F.lit(VECTORS_PER_DOC - 1), F.lit(7)).cast("array<long>")
    by_index = q.select(
        "query_id", F.lit("index").alias("label_kind"), F.explode(steps).alias("value")
    )
    return by_id.unionByName(by_index)


def index_meta(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    return (
        vectors(spark, sf)
        .groupBy("doc_id")
        .agg(F.count("*").alias("chunk_count"))
        .withColumn("embedding_model", F.when(d % 10 == 3, F.lit("m0")).otherwise(F.lit(MODEL)))
        .withColumn("status", F.when(d % 10 == 4, F.lit("BUILDING")).otherwise(F.lit("READY")))
    )


def messages(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    mid = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        mid.alias("message_id"),
        F.col("conv_id").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        F.when(mid % 11 == 5, F.lit("FAILURE")).otherwise(F.lit("SUCCESS")).alias("status"),
        instant(mid).alias("created_at"),
        F.when(mid % 3 == 0, instant(mid + 5)).alias("updated_at"),
    )


def citation_hits(spark, sf) -> DataFrame:
    """Three hits per assistant message."""
    m = messages(spark, sf).where(F.col("role") == "assistant").select("message_id", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"))
    vector_count = table(spark, sf, "embeddings").count()
    picked = m.withColumn("chunk_id", (F.col("message_id") * 7 + F.col("j") * 13) % vector_count)
    v = vectors(spark, sf).select("chunk_id", "doc_id", "chunk_index").join(vector_contents(spark, sf), "chunk_id")
    score = F.round(0.9 - 0.1 * F.col("j"), 6)
    rerank = F.when(F.col("message_id") % 3 != 0, F.round(0.2 + 0.3 * F.col("j"), 6))
    return picked.join(v, "chunk_id").select(
        "message_id",
        (F.col("j") + 1).alias("rank"),
        "doc_id",
        "chunk_id",
        "chunk_index",
        F.when(F.col("message_id") % 5 != 0, score).alias("score"),
        rerank.alias("rerank_score"),
        "content",
        F.lit("").alias("snippet"),
    )


def citations(spark, sf) -> DataFrame:
    h = citation_hits(spark, sf)
    return h.select(
        (F.col("message_id") * 10 + F.col("rank")).alias("id"),
        "message_id",
        "doc_id",
        "chunk_id",
        "chunk_index",
        F.coalesce("rerank_score", "score", F.lit(0.0)).alias("score"),
        F.substring("content", 1, 300).alias("snippet"),
    )


def tasks(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    step = F.floor(i / 3)
    stage = (
        F.when(i % 3 == 0, choose(step % 8, *STAGE_PROGRESS["ingest_document"]))
        .when(i % 3 == 1, choose(step % 6, *STAGE_PROGRESS["chat_generate"]))
        .otherwise(F.lit("started"))
    )
    return o.select(
        i.alias("id"),
        F.concat(F.lit("t"), i.cast("string")).alias("task_id"),
        choose(i % 3, "ingest_document", "chat_generate", "ping").alias("type"),
        choose(i % 3, "document", "message", "system").alias("entity_type"),
        F.col("o_custkey").alias("entity_id"),
        choose(i % 6, "PENDING", "STARTED", "PROGRESS", "SUCCESS", "FAILURE", "FAILED").alias("state"),
        (F.col("o_totalprice").cast("long") % 101).cast("int").alias("progress"),
        F.concat(F.lit('{"stage": "'), stage, F.lit('"}')).alias("meta_json"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def task_updates(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    state = (
        F.when(kind == "view", F.lit("STARTED"))
        .when(kind == "click", F.lit("PROGRESS"))
        .when(kind == "purchase", F.lit("SUCCESS"))
        .when(kind == "error", F.lit("FAILURE"))
    )
    return e.select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("task_id"),
        F.col("event_id").alias("seq"),
        state.alias("state"),
        F.when(F.col("event_id") % 4 != 0, F.floor(F.col("value") / 5).cast("int")).alias("progress"),
        F.when(kind == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
    )


def users(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), instant(F.col("c_custkey")).alias("created_at")
    )


def request_metrics(events: DataFrame) -> DataFrame:
    """Works on a batch or a stream of events."""
    i, kind, v = F.col("event_id"), F.col("event_type"), F.col("value")
    request = (
        F.when(kind == "view", F.lit("chat_stream"))
        .when(kind == "purchase", F.lit("ingest"))
        .when(kind == "signup", F.lit("retrieval"))
        .otherwise(F.lit("chat_async"))
    )
    failed = kind == "error"
    message = F.when(failed, choose(i % 2, "read timed out", "bad input"))
    k = F.get_json_object("props", "$.k")
    text = lambda c: c.cast("string")
    ingest_json = F.concat(
        F.lit('{"faiss_ms": '), k, F.lit(', "text_extract_ms": '), text(i % 50), F.lit(', "chunking_ms": '), text(i % 7),
        F.lit(', "chunk_insert_ms": '), text(i % 11), F.lit(', "embedding_ms": "'), text(i % 90),
        F.lit('", "index_ms": null, "chunk_count": '), text(i % 40), F.lit("}"),
    )
    search_json = F.concat(
        F.lit('{"recall_at_k": '), text((i % 5) / 4), F.lit(', "mrr": '), text((i % 3) / 2), F.lit(', "ndcg": "n/a"}')
    )
    extra = (
        F.when(i % 97 == 0, F.lit('{"faiss_ms": 1'))
        .when(kind == "purchase", ingest_json)
        .when(kind == "signup", search_json)
        .otherwise(F.concat(F.lit('{"faiss_ms": '), k, F.lit("}")))
    )
    e2e = F.round(v * 10).cast("int")
    return events.select(
        i.alias("id"),
        request.alias("request_type"),
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("user_id").alias("session_id"),
        e2e.alias("e2e_latency_ms"),
        F.when(kind == "view", F.floor(e2e / 3).cast("int")).alias("ttft_ms"),
        F.when(kind == "purchase", e2e + 40).alias("ready_latency_ms"),
        F.when(i % 5 != 0, F.round(v).cast("int")).alias("retrieval_ms"),
        F.when(i % 13 != 0, i % 400).cast("int").alias("prompt_tokens"),
        (i % 90).cast("int").alias("completion_tokens"),
        F.when(i % 7 != 0, ((i % 1000) / 100000).cast("decimal(16,8)")).alias("cost_usd"),
        (i % 4).cast("int").alias("citation_count"),
        (i % 17 == 0).alias("no_context"),
        (failed & (i % 2 == 0)).alias("timed_out"),
        message.alias("error_message"),
        extra.alias("extra_json"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def metrics(spark, sf) -> DataFrame:
    return request_metrics(spread(table(spark, sf, "events"), "event_id"))


def activity_intervals(spark, sf) -> DataFrame:
    """Requests as intervals; minutes stand for the milliseconds so that they overlap."""
    m = metrics(spark, sf)
    end = F.timestamp_micros(F.unix_micros("created_at") + F.col("e2e_latency_ms").cast("long") * 60_000_000)
    return m.select(
        "session_id",
        (F.col("request_type") == "chat_stream").alias("is_stream"),
        F.col("created_at").alias("started_at"),
        end.alias("ended_at"),
    )


def answers(spark, sf) -> DataFrame:
    m = messages(spark, sf).where(F.col("role") == "assistant")
    return m.select(F.col("message_id").alias("stream_id"), "session_id", F.col("content").alias("answer"), F.col("created_at").alias("requested_at"))


def stream_events(answers: DataFrame, size: int = 20) -> DataFrame:
    """Deltas of 20 characters 50 ms apart and a done event, missing for some sessions, an error for others."""
    pieces = fixed_pieces(F.col("answer"), size)
    n = F.size(pieces)
    event = lambda index, kind, delta, message: F.struct(
        index.cast("long").alias("index"), kind.alias("type"), delta.cast("string").alias("delta"), message.cast("string").alias("message")
    )
    nothing = F.lit(None).cast("string")
    deltas = F.transform(pieces, lambda p, i: event(i + 1, F.lit("delta"), p, nothing))
    failed = F.col("session_id") % 17 == 3
    last = F.when(failed, event(n + 1, F.lit("error"), nothing, F.lit("model went away"))).otherwise(
        event(n + 1, F.lit("done"), nothing, nothing)
    )
    tail = F.when(F.col("session_id") % 13 != 0, F.array(last)).otherwise(F.slice(F.array(last), 1, 0))
    rows = answers.select("stream_id", "requested_at", F.explode(F.concat(deltas, tail)).alias("e"))
    ts = F.timestamp_micros(F.unix_micros("requested_at") + F.col("e.index") * 50_000)
    return rows.select("stream_id", "requested_at", "e.index", "e.type", "e.delta", "e.message", ts.alias("ts"))


def thinking_answers(spark, sf) -> DataFrame:
    """Answers with a think block in front, in the middle, left open, or none."""
    a = answers(spark, sf)
    half = (F.char_length("answer") / 2).cast("int")
    first, second = F.substring("answer", F.lit(1), half), F.substring(F.col("answer"), half + 1, F.char_length("answer"))
    kind = F.col("stream_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("<think>plan\nmore</think>"), F.col("answer")))
        .when(kind == 1, F.concat(first, F.lit('<THINK mode="a">x < y </THINK>'), second))
        .when(kind == 2, F.concat(first, F.lit("<think>"), second))
        .otherwise(F.col("answer"))
    )
    return a.withColumn("answer", text)


def rate_requests(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") % 40).alias("ip"),
        F.col("user_id").alias("user"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def provider_responses(spark, sf) -> DataFrame:
    """One response per document text, in ten shapes; some texts look like lists or objects and are none."""
    d = texts(spark, sf)
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.concat(F.lit("<think>hm</think> "), F.col("text"))).otherwise(F.col("text"))

    def quoted(text):
        boxed = F.to_json(F.array(text))
        return F.substring(boxed, F.lit(2), F.char_length(boxed) - 2)

    usage = F.concat(
        F.lit(', "usage": {"prompt_tokens": '), (i % 400).cast("string"), F.lit(', "output_tokens": "'), (i % 90).cast("string"), F.lit('"}')
    )
    kind = i % 10
    said = lambda text: F.concat(F.lit('{"message": {"content": '), quoted(text), F.lit("}}"))
    choice = (
        F.when(kind == 0, said(body))
        .when(kind == 1, F.concat(F.lit('{"message": {"content": [{"type": "text", "text": '), quoted(body), F.lit('}, {"type": "image", "text": "no"}, null, "{tail"]}}')))
        .when(kind == 2, F.concat(F.lit('{"message": {"content": null}, "text": '), quoted(body), F.lit("}")))
        .when(kind == 3, F.lit('{"message": {"content": "<think>only</think>"}}'))
        .when(kind == 4, F.lit('{"finish_reason": "stop"}'))
        .when(kind == 6, said(F.concat(F.lit("[1] "), body)))
        .when(kind == 7, said(F.lit("[Chunk 1] yes")))
        .when(kind == 8, said(F.concat(F.lit("{"), body)))
        .when(kind == 9, said(F.lit('["a","b"]')))
        .otherwise(F.lit(""))
    )
    return d.select(
        "doc_id", F.concat(F.lit('{"choices": ['), choice, F.lit("]"), F.when(i % 2 == 0, usage).otherwise(F.lit("")), F.lit("}")).alias("response")
    )


def load_results(spark, sf) -> DataFrame:
    m = metrics(spark, sf)
    i = F.col("id")
    return m.where(F.col("request_type").isin("chat_async", "chat_stream")).select(
        "id",
        F.when(F.col("request_type") == "chat_stream", F.lit("stream")).otherwise(F.lit("async")).alias("mode"),
        (F.col("status") == "success").alias("success"),
        "timed_out",
        F.when(i % 3 == 0, F.lit(0.0)).otherwise(F.col("ttft_ms").cast("double")).alias("server_ttft_ms"),
        (F.col("ttft_ms") + 2).cast("double").alias("ttft_ms"),
        F.when(i % 4 != 0, F.col("e2e_latency_ms").cast("double")).alias("server_e2e_ms"),
        (F.col("e2e_latency_ms") + 5).cast("double").alias("client_e2e_ms"),
        "retrieval_ms",
        "prompt_tokens",
        "completion_tokens",
        "citation_count",
        "cost_usd",
        "no_context",
    )
