"""SQL twins of the table adapters, for the side-by-side check in DuckDB."""

from __future__ import annotations

_WIDE = "".join(
    [r"\x1c-\x1f", r"\x{85}", r"\x{a0}", r"\x{1680}", r"\x{2000}-\x{200a}", r"\x{2028}", r"\x{2029}", r"\x{202f}", r"\x{205f}", r"\x{3000}"]
)
WS = rf"[\s\x0b{_WIDE}]"
LINE_WS = rf"[ \t\x0b\f{_WIDE}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+\z', '', 'g')"


def normal(x: str) -> str:
    t = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '{LINE_WS}+(\n|\z)', '\1', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def tokens(x: str) -> str:
    body = strip(f"coalesce({x}, '')")
    words = f"len(regexp_split_to_array({body}, '{WS}+'))"
    return f"(CASE WHEN {body} = '' THEN 0 WHEN {words} > 1 THEN {words} ELSE length({body}) END)::INTEGER"


def windows(n: str, size: int = 800, overlap: int = 100) -> str:
    step = float(size - overlap)
    return f"(CASE WHEN {n} <= 0 THEN 0 ELSE greatest(0, ceil(({n} - {size}) / {step})::BIGINT) + 1 END)::BIGINT"


def think(x: str) -> str:
    return strip(rf"regexp_replace({x}, '(?is)<think\b[^>]*>.*?(?:</think>|\z)', '', 'g')")


def pick(number: str, *values: str) -> str:
    items = ", ".join("'" + v + "'" for v in values)
    return f"([{items}])[({number}) + 1]"


def cut(x: str, limit: int, tail: str) -> str:
    return f"(CASE WHEN length({x}) <= {limit} THEN {x} ELSE substring({x}, 1, {limit}) || {tail} END)"


def four(x: str) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(18,6)) AS DECIMAL(18,4)) AS VARCHAR)"


def quantile(x: str, p: float, digits: int = 1, where: str = "true") -> str:
    return f"round(round(quantile_cont({x}::DOUBLE, {p}) FILTER (WHERE {where}), 6), {digits})"


def instant(x: str) -> str:
    return f"(TIMESTAMP '2024-01-01' + to_seconds({x}))"


def number(field: str, text: str = "extra_json") -> str:
    return f"(CASE WHEN json_valid({text}) THEN TRY_CAST(nullif(json_extract_string({text}, '$.{field}'), '') AS DOUBLE) END)"


CHAT = "request_type IN ('chat_async', 'chat_stream')"
CHAT_OK = f"({CHAT} AND status = 'success')"
INGEST_OK = "(request_type = 'ingest' AND status = 'success')"

# name -> (needed names, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def using(*names: str, body: str, extra: tuple[tuple[str, str], ...] = (), stored: tuple[str, ...] = ()) -> str:
    """A statement with the named adapter tables (and those they need) as CTEs; ``stored`` ones are computed once and kept."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS {'MATERIALIZED ' if n in stored else ''}({b})" for n, b in [*((n, CTES[n][1]) for n in order), *extra]]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


cte(
    "corpus",
    f"""SELECT doc_id AS id, doc_id % 50 AS user_id,
    'd:' || doc_id || {pick('doc_id % 8', '.md', '.txt', '.JSON', '.csv', '.pdf', '.docx', '.exe', '')} AS filename,
    sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes,
    {pick('doc_id % 10', 'FAILED', 'INGESTING', 'UPLOADED', *['READY'] * 7)} AS status, text
  FROM documents""",
)
cte("normal_docs", f"SELECT doc_id, {normal('text')} AS t FROM documents")
cte("windows", f"SELECT doc_id, t, unnest(range(0, {windows('length(t)')})) AS pos FROM normal_docs", "normal_docs")
cte("pieces", f"SELECT doc_id, pos, {strip('substring(t, (pos * 700 + 1)::BIGINT, 800)')} AS content FROM windows", "windows")
cte(
    "chunks",
    f"""SELECT doc_id, chunk_index, content, {tokens('content')} AS tokens_est, doc_id * 1000000 + chunk_index AS chunk_id
  FROM (SELECT doc_id, content, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS chunk_index
        FROM pieces WHERE content <> '')""",
    "pieces",
)
cte(
    "vectors",
    "SELECT vec_id AS chunk_id, vec_id // 50 AS doc_id, (vec_id % 50)::INTEGER AS chunk_index, embedding, label FROM embeddings",
)
cte(
    "contents",
    "SELECT vec_id AS chunk_id, coalesce(text, 'empty') AS content FROM embeddings LEFT JOIN documents ON doc_id = vec_id",
)
cte(
    "queries",
    """SELECT chunk_id AS query_id, doc_id, embedding, label, text AS question
  FROM vectors, (SELECT count(*) AS items FROM benchmark) JOIN benchmark ON item_id = chunk_id % items""",
    "vectors",
)
cte(
    "pair_scores",
    """SELECT q.query_id, v.doc_id, v.chunk_id, v.chunk_index,
    round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM queries q JOIN vectors v USING (doc_id)""",
    "queries",
    "vectors",
)
cte(
    "ranked",
    """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_id) AS original_rank
  FROM pair_scores""",
    "pair_scores",
)
cte("top5", "SELECT * EXCLUDE (original_rank), original_rank AS rank FROM ranked WHERE original_rank <= 5", "ranked")
cte("chunk_words", f"SELECT chunk_id, list_distinct(regexp_split_to_array({strip('lower(content)')}, '{WS}+')) AS words FROM contents", "contents")
cte(
    "asked_words",
    f"SELECT question, list_distinct(regexp_split_to_array({strip('lower(question)')}, '{WS}+')) AS asked FROM (SELECT DISTINCT question FROM queries)",
    "queries",
)
cte(
    "candidates",
    """SELECT r.*, question, asked, words
  FROM ranked r JOIN (SELECT query_id, question FROM queries) USING (query_id) JOIN asked_words USING (question) JOIN chunk_words USING (chunk_id)
  WHERE original_rank <= 30""",
    "ranked",
    "queries",
    "asked_words",
    "chunk_words",
)
cte(
    "scored",
    """SELECT * EXCLUDE (asked, words), round(len(list_intersect(asked, words))::DOUBLE / len(asked), 6) AS rerank_score
  FROM candidates""",
    "candidates",
)
cte(
    "reranked",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY rerank_score DESC, score DESC, original_rank) AS rank FROM scored) WHERE rank <= 5""",
    "scored",
)
cte(
    "labels_set",
    """SELECT DISTINCT * FROM (
    SELECT q.chunk_id AS query_id, 'id' AS label_kind, v.chunk_id AS value FROM vectors q JOIN vectors v USING (doc_id, label)
    UNION ALL SELECT chunk_id, 'index', unnest(range(0, 50, 7)) FROM vectors)""",
    "vectors",
)
cte("relevant_counts", "SELECT query_id, count(*) AS relevant_count FROM labels_set GROUP BY query_id", "labels_set")
cte(
    "marked5",
    """SELECT h.*, EXISTS (SELECT 1 FROM labels_set l WHERE l.query_id = h.query_id
      AND ((label_kind = 'id' AND value = chunk_id) OR (label_kind = 'index' AND value = chunk_index))) AS relevant
  FROM top5 h""",
    "top5",
    "labels_set",
)
cte(
    "eval5",
    """SELECT query_id, relevant_count, relevant_hit_count, round(relevant_hit_count / relevant_count, 6) AS recall_at_k,
    coalesce(round(1.0 / first_rank, 6), 0.0) AS mrr,
    round(dcg / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(relevant_count, hits) + 1) t(i)), 6) AS ndcg
  FROM (SELECT query_id, any_value(relevant_count) AS relevant_count, count(rank) AS hits,
      count(*) FILTER (WHERE relevant) AS relevant_hit_count, min(rank) FILTER (WHERE relevant) AS first_rank,
      coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE relevant), 0.0) AS dcg
    FROM relevant_counts LEFT JOIN marked5 USING (query_id) GROUP BY query_id)""",
    "marked5",
    "relevant_counts",
)
cte(
    "messages",
    f"""SELECT mid AS message_id, conv_id AS session_id, role, text AS content,
    CASE WHEN mid % 11 = 5 THEN 'FAILURE' ELSE 'SUCCESS' END AS status, {instant('mid')} AS created_at,
    CASE WHEN mid % 3 = 0 THEN {instant('mid + 5')} END AS updated_at
  FROM (SELECT *, conv_id * 1000 + turn AS mid FROM conversations)""",
)
cte(
    "citation_hits",
    """SELECT message_id, (j + 1)::INTEGER AS rank, v.doc_id, v.chunk_id, v.chunk_index,
    CASE WHEN message_id % 5 <> 0 THEN round(0.9::DOUBLE - 0.1::DOUBLE * j, 6) END AS score,
    CASE WHEN message_id % 3 <> 0 THEN round(0.2::DOUBLE + 0.3::DOUBLE * j, 6) END AS rerank_score, content
  FROM (SELECT message_id, unnest([0, 1, 2]) AS j FROM messages WHERE role = 'assistant') m
  JOIN vectors v ON v.chunk_id = (message_id * 7 + j * 13) % (SELECT count(*) FROM embeddings) JOIN contents USING (chunk_id)""",
    "messages",
    "vectors",
    "contents",
)
cte(
    "citations",
    """SELECT message_id * 10 + rank AS id, message_id, doc_id, chunk_id, chunk_index,
    coalesce(rerank_score, score, 0.0) AS score, substring(content, 1, 300) AS snippet FROM citation_hits""",
    "citation_hits",
)
cte(
    "tasks",
    f"""SELECT o_orderkey AS id, 't' || o_orderkey AS task_id,
    {pick('o_orderkey % 3', 'ingest_document', 'chat_generate', 'ping')} AS type,
    {pick('o_orderkey % 3', 'document', 'message', 'system')} AS entity_type, o_custkey AS entity_id,
    {pick('o_orderkey % 6', 'PENDING', 'STARTED', 'PROGRESS', 'SUCCESS', 'FAILURE', 'FAILED')} AS state,
    (trunc(o_totalprice)::BIGINT % 101)::INTEGER AS progress, o_orderdate AS created_at
  FROM orders""",
)
cte(
    "task_updates",
    """SELECT user_id * 10 + event_id % 10 AS task_id, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'STARTED' WHEN 'click' THEN 'PROGRESS' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' END AS state,
    CASE WHEN event_id % 4 <> 0 THEN floor(value / 5)::INTEGER END AS progress,
    CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error
  FROM events""",
)
cte(
    "latest_tasks",
    """SELECT task_id, arg_max(state, seq) FILTER (WHERE state IS NOT NULL) AS state,
    arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress,
    arg_max(error, seq) FILTER (WHERE error IS NOT NULL) AS error
  FROM task_updates GROUP BY task_id""",
    "task_updates",
)
cte("users", f"SELECT c_custkey AS id, c_name AS username, {instant('c_custkey')} AS created_at FROM customer")
_K = "json_extract_string(props, '$.k')"
cte(
    "metrics",
    f"""SELECT event_id AS id,
    CASE event_type WHEN 'view' THEN 'chat_stream' WHEN 'purchase' THEN 'ingest' WHEN 'signup' THEN 'retrieval' ELSE 'chat_async' END AS request_type,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, user_id AS session_id,
    e2e AS e2e_latency_ms, CASE WHEN event_type = 'view' THEN floor(e2e / 3)::INTEGER END AS ttft_ms,
    CASE WHEN event_type = 'purchase' THEN e2e + 40 END AS ready_latency_ms,
    CASE WHEN event_id % 5 <> 0 THEN round(value)::INTEGER END AS retrieval_ms,
    CASE WHEN event_id % 13 <> 0 THEN (event_id % 400)::INTEGER END AS prompt_tokens, (event_id % 90)::INTEGER AS completion_tokens,
    CASE WHEN event_id % 7 <> 0 THEN CAST((event_id % 1000) / 100000.0::DOUBLE AS DECIMAL(16,8)) END AS cost_usd,
    (event_id % 4)::INTEGER AS citation_count, event_id % 17 = 0 AS no_context,
    event_type = 'error' AND event_id % 2 = 0 AS timed_out,
    CASE WHEN event_type = 'error' THEN {pick('event_id % 2', 'read timed out', 'bad input')} END AS error_message,
    CASE WHEN event_id % 97 = 0 THEN '{{"faiss_ms": 1'
      WHEN event_type = 'purchase' THEN '{{"faiss_ms": ' || {_K} || ', "text_extract_ms": ' || event_id % 50 || ', "chunking_ms": ' || event_id % 7
        || ', "chunk_insert_ms": ' || event_id % 11 || ', "embedding_ms": "' || event_id % 90 || '", "index_ms": null, "chunk_count": ' || event_id % 40 || '}}'
      WHEN event_type = 'signup' THEN '{{"recall_at_k": ' || (event_id % 5) / 4.0::DOUBLE || ', "mrr": ' || (event_id % 3) / 2.0::DOUBLE || ', "ndcg": "n/a"}}'
      ELSE '{{"faiss_ms": ' || {_K} || '}}' END AS extra_json,
    ts AS created_at
  FROM (SELECT *, round(value * 10)::INTEGER AS e2e FROM events)""",
)
cte("answers", "SELECT message_id AS stream_id, session_id, content AS answer, created_at AS requested_at FROM messages WHERE role = 'assistant'", "messages")
cte(
    "deltas",
    """SELECT stream_id, session_id, requested_at, i + 1 AS index, substring(answer, (i * 20 + 1)::BIGINT, 20) AS delta
  FROM (SELECT *, unnest(range(0, ceil(length(answer) / 20.0)::BIGINT)) AS i FROM answers)""",
    "answers",
)
cte(
    "stream_events",
    """SELECT stream_id, requested_at, index, type, delta, message, requested_at + to_milliseconds(index * 50) AS ts FROM (
    SELECT stream_id, requested_at, index, 'delta' AS type, delta, NULL AS message FROM deltas
    UNION ALL
    SELECT stream_id, requested_at, ceil(length(answer) / 20.0)::BIGINT + 1, CASE WHEN session_id % 17 = 3 THEN 'error' ELSE 'done' END,
      NULL, CASE WHEN session_id % 17 = 3 THEN 'model went away' END FROM answers WHERE session_id % 13 <> 0)""",
    "deltas",
    "answers",
)
cte(
    "thinking",
    """SELECT stream_id, session_id, requested_at, CASE stream_id % 4
      WHEN 0 THEN '<think>plan' || chr(10) || 'more</think>' || answer
      WHEN 1 THEN substring(answer, 1, h) || '<THINK mode="a">x < y </THINK>' || substring(answer, h + 1)
      WHEN 2 THEN substring(answer, 1, h) || '<think>' || substring(answer, h + 1) ELSE answer END AS answer
  FROM (SELECT *, length(answer) // 2 AS h FROM answers)""",
    "answers",
)
cte(
    "responses",
    """SELECT doc_id, '{"choices": [' || CASE doc_id % 6
      WHEN 0 THEN '{"message": {"content": ' || q || '}}'
      WHEN 1 THEN '{"message": {"content": [{"type": "text", "text": ' || q || '}, {"type": "image", "text": "no"}, "tail"]}}'
      WHEN 2 THEN '{"text": ' || q || '}' WHEN 3 THEN '{"message": {"content": "<think>only</think>"}}'
      WHEN 4 THEN '{"finish_reason": "stop"}' ELSE '' END || ']'
      || CASE WHEN doc_id % 2 = 0 THEN ', "usage": {"prompt_tokens": ' || doc_id % 400 || ', "output_tokens": "' || doc_id % 90 || '"}' ELSE '' END || '}' AS response
  FROM (SELECT doc_id, to_json(CASE WHEN doc_id % 3 = 0 THEN '<think>hm</think> ' || text ELSE text END)::VARCHAR AS q FROM documents)""",
)
cte(
    "load_results",
    """SELECT id, CASE WHEN request_type = 'chat_stream' THEN 'stream' ELSE 'async' END AS mode, status = 'success' AS success, timed_out,
    CASE WHEN id % 3 = 0 THEN 0.0 ELSE ttft_ms END::DOUBLE AS server_ttft_ms, (ttft_ms + 2)::DOUBLE AS ttft_ms,
    CASE WHEN id % 4 <> 0 THEN e2e_latency_ms END::DOUBLE AS server_e2e_ms, (e2e_latency_ms + 5)::DOUBLE AS client_e2e_ms,
    retrieval_ms, prompt_tokens, completion_tokens, citation_count, cost_usd, no_context
  FROM metrics WHERE request_type IN ('chat_async', 'chat_stream')""",
    "metrics",
)
