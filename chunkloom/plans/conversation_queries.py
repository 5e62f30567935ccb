"""Sessions, messages, citations, history and answer records."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T
from chunkloom.operators import conversations as C, metrics as M, prompts as P
from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query
from chunkloom.session import scratch_path
from chunkloom.sources import sinks


@query(O.using("messages", body=f"""SELECT message_id, trim(bad_role) AS role, {O.strip('body')} AS content, upper(st) AS status,
    concat_ws('; ', CASE WHEN trim(bad_role) NOT IN ('user', 'assistant', 'system') THEN 'invalid role' END,
      CASE WHEN {O.strip('body')} = '' THEN 'content is empty' END,
      CASE WHEN upper(st) NOT IN ('PENDING', 'PROCESSING', 'SUCCESS', 'FAILURE') THEN 'invalid message status' END) AS reasons
  FROM (SELECT message_id, CASE WHEN message_id % 10 = 4 THEN 'robot' ELSE ' ' || role END AS bad_role,
    CASE WHEN message_id % 7 = 2 THEN chr(32) || chr(10) ELSE content END AS body,
    CASE WHEN message_id % 9 = 1 THEN 'done' ELSE lower(status) END AS st FROM messages)"""))
def validate_messages(spark, sf):
    i = F.col("message_id")
    raw = A.messages(spark, sf).select(
        "message_id",
        F.when(i % 10 == 4, F.lit("robot")).otherwise(F.concat(F.lit(" "), F.col("role"))).alias("role"),
        F.when(i % 7 == 2, F.lit(" \n")).otherwise(F.col("content")).alias("content"),
        F.when(i % 9 == 1, F.lit("done")).otherwise(F.lower("status")).alias("status"),
    )
    checked = C.validate_messages(raw)
    return checked.withColumn("reasons", F.array_join("reasons", "; "))


@query(O.using("messages", body="""SELECT r.message_id, r.session_id, CASE WHEN m.message_id IS NULL THEN 'message not found'
    WHEN m.session_id <> r.session_id THEN 'message does not belong to session'
    WHEN m.role <> 'user' THEN 'message is not a user message' END AS reject_reason
  FROM (SELECT message_id + (message_id % 2) * 500 AS message_id, session_id + CASE WHEN message_id % 5 = 0 THEN 1 ELSE 0 END AS session_id FROM messages) r
  LEFT JOIN messages m USING (message_id)"""))
def message_session_check(spark, sf):
    m = A.messages(spark, sf)
    i = F.col("message_id")
    asked = m.select(
        (i + (i % 2) * 500).alias("message_id"),
        (F.col("session_id") + F.when(i % 5 == 0, 1).otherwise(0)).alias("session_id"),
    )
    return C.message_session_check(asked, m)


@query(O.using("messages", "citations", body="""SELECT m.message_id, m.role, count(c.id) AS citations_count,
    coalesce(string_agg(c.id || ':' || c.chunk_index || ':' || c.score, ',' ORDER BY c.score DESC, c.id), '') AS citations
  FROM messages m LEFT JOIN citations c USING (message_id) GROUP BY ALL"""))
def messages_with_citations(spark, sf):
    nested = C.messages_with_citations(A.messages(spark, sf).select("message_id", "role"), A.citations(spark, sf))
    line = lambda c: F.concat_ws(":", c["citation_id"].cast("string"), c["chunk_index"].cast("string"), c["score"].cast("string"))
    return nested.select(
        "message_id",
        "role",
        F.size("citations").cast("long").alias("citations_count"),
        F.array_join(F.transform("citations", line), ",").alias("citations"),
    )


@query(O.using("messages", "citations", body="""SELECT m.message_id, m.role, c.id AS citation_id, c.chunk_index, c.score,
    row_number() OVER (PARTITION BY m.message_id ORDER BY c.score DESC, c.id) AS position
  FROM messages m JOIN citations c USING (message_id)"""))
def message_citations_flat(spark, sf):
    flat = C.message_citations_flat(A.messages(spark, sf).select("message_id", "role"), A.citations(spark, sf))
    return flat.select("message_id", "role", F.col("id").alias("citation_id"), "chunk_index", "score", "position")


_CITED = """SELECT message_id, rank, doc_id, chunk_id, chunk_index, coalesce(rerank_score, score, 0.0) AS score,
  substring(content, 1, 300) AS snippet, substring(content, 1, 200) AS preview FROM citation_hits"""


@query(O.using("citation_hits", body=_CITED))
def citation_rows(spark, sf):
    return C.citation_rows(A.citation_hits(spark, sf))


@query(O.using("citation_hits", body=_CITED))
def write_citations(spark, sf):
    path = scratch_path(spark, "citations")
    for _ in range(2):  # the second time is a retry
        sinks.write_citations(C.citation_rows(A.citation_hits(spark, sf)), path, "1")
    return spark.read.parquet(path).drop("batch")


@query(O.using("citations", body="SELECT id, message_id, score FROM citations"))
def order_citations(spark, sf):
    return C.order_citations(A.citations(spark, sf)).select("id", "message_id", "score")


@query(O.using("messages", body="""SELECT session_id, count(*) AS message_count, arg_max(coalesce(updated_at, created_at), message_id) AS updated_at
  FROM messages GROUP BY session_id"""))
def session_summary(spark, sf):
    return C.session_summary(A.messages(spark, sf))


@query(O.using("messages", body="""SELECT session_id, message_id, position::INTEGER AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id) AS position FROM messages) WHERE position <= 100"""))
def list_messages_asc(spark, sf):
    return C.list_messages_asc(A.messages(spark, sf)).select("session_id", "message_id", "position")


_HISTORY = (
    "history",
    f"""SELECT session_id, message_id, role, content, row_number() OVER (PARTITION BY session_id ORDER BY message_id)::INTEGER AS position
  FROM (SELECT n.*, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS back
    FROM (SELECT session_id, message_id, role, status, {O.strip('content')} AS content,
        row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS newest FROM messages) n
    LEFT JOIN (SELECT session_id, arg_max(message_id, message_id) AS qid, arg_max(content, message_id) AS question
      FROM messages WHERE role = 'user' GROUP BY session_id) q USING (session_id)
    WHERE newest <= 10 AND role IN ('user', 'assistant') AND content <> '' AND NOT (role = 'assistant' AND status <> 'SUCCESS')
      AND message_id IS DISTINCT FROM qid AND NOT (role = 'user' AND content = coalesce(question, '')))
  WHERE back <= 6""",
)


@query(O.using("messages", extra=(_HISTORY,), body="SELECT session_id, message_id, role, content, position FROM history"))
def recent_history(spark, sf):
    m = A.messages(spark, sf)
    return C.recent_history(m, C.current_questions(m)).select("session_id", "message_id", "role", "content", "position")


@query(O.using("messages", body=f"SELECT session_id, sum({O.tokens('role')} + {O.tokens('content')} + 4)::BIGINT AS tokens FROM messages GROUP BY session_id"))
def estimate_message_tokens(spark, sf):
    return C.estimate_message_tokens(A.messages(spark, sf))


def _chat(spark, sf):
    """Chat messages of every session's question with its last citations as context."""
    m = A.messages(spark, sf)
    q = C.current_questions(m)
    asked = q.select(F.col("session_id").alias("query_id"), "session_id", "question")
    hits = A.citation_hits(spark, sf).withColumn("session_id", F.floor(F.col("message_id") / 1000).cast("long"))
    newest = hits.groupBy("session_id").agg(F.max("message_id").alias("message_id"))
    context = hits.join(newest, ["session_id", "message_id"]).withColumnRenamed("session_id", "query_id")
    context = context.withColumn("original_rank", F.lit(None).cast("int"))
    return P.build_chat_messages(asked, C.recent_history(m, q), context)


_CHAT_LINES = f"""SELECT session_id AS query_id, 0 AS part, 0 AS n, 'system' AS role, '{K.SYSTEM_INSTRUCTION.replace(chr(10), "' || chr(10) || '")}' AS content
    FROM messages WHERE role = 'user' GROUP BY session_id
  UNION ALL SELECT session_id, 1, position, role, content FROM history WHERE session_id IN (SELECT session_id FROM messages WHERE role = 'user')
  UNION ALL SELECT session_id, 2, 0, 'system', '已检索内容：' || chr(10) || chr(10) || string_agg('[Chunk ' || rank || '] | doc_id=' || doc_id || ' | chunk_index=' || chunk_index
      || coalesce(' | score=' || {O.four('score')}, '') || coalesce(' | rerank_score=' || {O.four('rerank_score')}, '') || chr(10) || {O.strip('content')}, chr(10) || chr(10) ORDER BY rank)
    FROM (SELECT *, message_id // 1000 AS session_id FROM citation_hits WHERE message_id IN (SELECT max(message_id) FROM messages WHERE role = 'assistant' GROUP BY session_id))
    WHERE session_id IN (SELECT session_id FROM messages WHERE role = 'user') GROUP BY session_id
  UNION ALL SELECT session_id, 3, 0, 'user', arg_max(content, message_id) FROM messages WHERE role = 'user' GROUP BY session_id"""
_CHAT = (_HISTORY, ("chat", _CHAT_LINES))


@query(O.using("messages", "citation_hits", extra=_CHAT, body="""SELECT query_id, count(*)::INTEGER AS messages,
    string_agg(role || ': ' || content, chr(10) ORDER BY part, n) AS text FROM chat GROUP BY query_id"""))
def build_chat_messages(spark, sf):
    line = lambda m: F.concat(m["role"], F.lit(": "), m["content"])
    return _chat(spark, sf).select(
        "query_id", F.size("messages").alias("messages"), F.array_join(F.transform("messages", line), "\n").alias("text")
    )


_ONE_LINE = "replace(content, chr(10), '\\n')"


@query(O.using("messages", "citation_hits", extra=(*_CHAT, ("previews", f"""SELECT query_id, string_agg('[' || i || '] role=' || role || ' content=' ||
    {O.cut(_ONE_LINE, 300, "'...(truncated)'")}, chr(10) ORDER BY i) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, n) AS i FROM chat) GROUP BY query_id""")),
    body=f"SELECT query_id, {O.cut('t', 4000, 'chr(10) || ' + chr(39) + '...(prompt preview truncated)' + chr(39))} AS preview FROM previews"))
def prompt_preview(spark, sf):
    return _chat(spark, sf).select("query_id", P.prompt_preview(F.col("messages")).alias("preview"))


# --- provider answers --------------------------------------------------------

_CONTENT = """CASE doc_id % 10 WHEN 0 THEN body WHEN 1 THEN body || '{tail' WHEN 2 THEN body WHEN 3 THEN '<think>only</think>'
    WHEN 6 THEN '[1] ' || body WHEN 7 THEN '[Chunk 1] yes' WHEN 8 THEN '{' || body WHEN 9 THEN '["a","b"]' END"""
_BODIES = (
    "bodies",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<think>hm</think> ' || text ELSE text END AS body FROM documents""",
)


@query(O.using(extra=(_BODIES,), body=f"SELECT doc_id, {_CONTENT} AS content FROM bodies"))
def flatten_content_parts(spark, sf):
    return A.provider_responses(spark, sf).select("doc_id", R.flatten_content(R.answer_content(F.col("response"))).alias("content"))


@query(O.using(extra=(_BODIES,), body=f"""SELECT doc_id, nullif(answer, '') AS answer, CASE WHEN doc_id % 10 = 5 THEN 'llm response missing choices'
    WHEN answer IS NULL THEN 'llm response missing answer content' WHEN answer = '' THEN 'llm response answer is empty' END AS error
  FROM (SELECT doc_id, {O.think(_CONTENT)} AS answer FROM bodies)"""))
def extract_answer(spark, sf):
    got = A.provider_responses(spark, sf).select("doc_id", R.extract_answer(F.col("response")).alias("r"))
    return got.select("doc_id", "r.answer", "r.error")


@query(O.using(extra=(_BODIES,), body=f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 400 ELSE 7 END AS prompt_tokens,
    CASE WHEN doc_id % 2 = 0 THEN doc_id % 90 ELSE {O.tokens('body')} END AS completion_tokens,
    CASE WHEN doc_id % 2 = 0 THEN doc_id % 400 + doc_id % 90 ELSE 7 + {O.tokens('body')} END AS total_tokens,
    CASE WHEN doc_id % 2 = 0 THEN 'provider' ELSE 'estimated' END AS token_source FROM bodies"""))
def usage_metrics(spark, sf):
    think = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>hm</think> "), F.col("text"))).otherwise(F.col("text"))
    body = A.texts(spark, sf).select("doc_id", think.alias("answer_text"))
    answers = A.provider_responses(spark, sf).select("doc_id", F.get_json_object("response", "$.usage").alias("usage_json"))
    joined = answers.join(body, "doc_id").withColumn("prompt_estimate", F.lit(7))
    return M.usage_metrics(joined).select("doc_id", "prompt_tokens", "completion_tokens", "total_tokens", "token_source")


@query(O.using("metrics", body="""SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE
    round(coalesce(prompt_tokens, 0) * 0.5::DOUBLE / 1000.0 + completion_tokens * 1.5::DOUBLE / 1000.0 + citation_count * 0.02::DOUBLE / 1000.0, 8) END::DOUBLE AS cost_usd FROM metrics"""))
def chat_cost(spark, sf):
    source = F.when(F.col("id") % 3 == 0, F.lit("mock_fallback")).otherwise(F.lit("llm"))
    rows = A.metrics(spark, sf).drop("cost_usd").withColumns({"answer_source": source, "query_tokens": F.col("citation_count")})
    return M.chat_cost(rows, 0.5, 1.5, 0.02).select("id", "cost_usd")


@query(O.using("metrics", body=f"""SELECT id, CASE WHEN json_valid(extra_json) THEN json_extract_string(extra_json, '$.faiss_ms') END AS faiss_ms,
    CASE WHEN json_valid(extra_json) THEN len(json_keys(extra_json)) ELSE 0 END::INTEGER AS fields FROM metrics"""))
def decode_json_column(spark, sf):
    rows = A.metrics(spark, sf).select("id", R.decode_json_map(F.col("extra_json")).alias("m"))
    return rows.select("id", F.try_element_at("m", F.lit("faiss_ms")).alias("faiss_ms"), F.size("m").alias("fields"))


@query("""SELECT event_id, TRY_CAST(v AS BIGINT) AS as_int, TRY_CAST(v AS DOUBLE) AS as_float FROM
  (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN 'n/a' ELSE user_id::VARCHAR END AS v FROM events)""")
def safe_numeric_cast(spark, sf):
    e = A.table(spark, sf, "events")
    i = F.col("event_id")
    text = (
        F.when(i % 4 == 0, F.lit(""))
        .when(i % 4 == 1, F.get_json_object("props", "$.k"))
        .when(i % 4 == 2, F.lit("n/a"))
        .otherwise(F.col("user_id").cast("string"))
    )
    return e.select("event_id", R.safe_int(text).alias("as_int"), R.safe_float(text).alias("as_float"))


@query(O.using("messages", body="SELECT message_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_iso, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_iso FROM messages"))
def iso_timestamp(spark, sf):
    return A.messages(spark, sf).select(
        "message_id", R.iso_timestamp(F.col("created_at")).alias("created_iso"), R.iso_timestamp(F.col("updated_at")).alias("updated_iso")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, epoch_ms(l_shipdate) - epoch_ms(o_orderdate))::BIGINT AS ready_ms
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def ready_latency(spark, sf):
    items = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    wait = R.elapsed_ms(F.col("o_orderdate"), F.col("l_shipdate"))
    return items.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", wait.alias("ready_ms"))


@query(O.using("thinking", body=f"SELECT stream_id, {O.think('answer')} AS answer FROM thinking"))
def strip_think_tags(spark, sf):
    return A.thinking_answers(spark, sf).select("stream_id", T.strip_think_tags(F.col("answer")).alias("answer"))
