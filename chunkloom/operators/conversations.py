"""Sessions, messages, history and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T
from chunkloom.operators.ranking import running_totals, top_n


def validate_messages(messages: DataFrame) -> DataFrame:
    """Messages with cleaned fields and the list of reasons against them (empty when good)."""
    role = R.stripped_or_empty(F.col("role"))
    content = R.stripped_or_empty(F.col("content"))
    status = F.upper(R.stripped_or_empty(F.col("status")))
    reasons = F.array_compact(
        F.array(
            F.when(~role.isin(*K.MESSAGE_ROLES), F.lit("invalid role")),
            F.when(content == "", F.lit("content is empty")),
            F.when(~status.isin(*K.MESSAGE_STATUSES), F.lit("invalid message status")),
        )
    )
    return messages.withColumns({"role": role, "content": content, "status": status, "reasons": reasons})


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of a frame with ``reasons``."""
    good = F.size("reasons") == 0
    return checked.where(good).drop("reasons"), checked.where(~good)


def message_session_check(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Chat requests (request_id, session_id, message_id) with the reason they cannot run."""
    m = messages.select("message_id", F.col("session_id").alias("_session"), F.col("role").alias("_role"))
    reason = (
        F.when(F.col("_session").isNull(), F.lit("message not found"))
        .when(F.col("_session") != F.col("session_id"), F.lit("message does not belong to session"))
        .when(F.col("_role") != "user", F.lit("message is not a user message"))
    )
    return requests.join(m, "message_id", "left").withColumn("reject_reason", reason).drop("_session", "_role")


def citation_rows(hits: DataFrame) -> DataFrame:
    """Citations of raw hits (message_id, rank, ...): rerank score first, then vector score, then 0."""
    score = F.coalesce("rerank_score", "score", F.lit(0.0))
    body = F.coalesce("content", F.lit(""))
    snippet = F.coalesce(F.nullif("snippet", F.lit("")), T.left(body, K.CITATION_SNIPPET_CHARS))
    return hits.select(
        "message_id",
        "rank",
        "doc_id",
        "chunk_id",
        "chunk_index",
        score.alias("score"),
        snippet.alias("snippet"),
        T.left(body, K.CITATION_PREVIEW_CHARS).alias("preview"),
    )


def order_citations(citations: DataFrame) -> DataFrame:
    """Global order by range partitioning, so a message with many citations still spreads."""
    return citations.orderBy(F.asc("message_id"), F.desc("score"), F.asc("id"))


def messages_with_citations(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages with all their citations as one array ordered by (score desc, id), empty without any.

    A message cites at most the top-k of its request (100), so the array is a value. Where callers attach more than that
    to one message, :func:`message_citations_flat` gives the same order as rows.
    """
    item = F.struct(
        (-F.coalesce("score", F.lit(0.0))).alias("minus_score"),
        F.col("id").alias("citation_id"),
        "doc_id",
        "chunk_id",
        "chunk_index",
        F.coalesce("snippet", F.lit("")).alias("snippet"),
    )
    grouped = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    public = F.transform(
        "_items",
        lambda c: F.struct(
            c["citation_id"].alias("citation_id"),
            c["doc_id"].alias("doc_id"),
            c["chunk_id"].alias("chunk_id"),
            c["chunk_index"].alias("chunk_index"),
            (-c["minus_score"]).alias("score"),
            c["snippet"].alias("snippet"),
        ),
    )
    kind = "array<struct<citation_id:bigint,doc_id:bigint,chunk_id:bigint,chunk_index:int,score:double,snippet:string>>"
    out = messages.join(grouped, "message_id", "left")
    return out.withColumn("citations", F.coalesce(public.cast(kind), F.array().cast(kind))).drop("_items")


def message_citations_flat(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """A row per (message, citation) with its ``position`` in (score desc, id), whatever their number per message.

    Positions are counted in steps of the score first and inside a step then, so that a message with a third of all
    citations is numbered by many tasks. Messages without citations give no row.
    """
    score = F.coalesce("score", F.lit(0.0))
    step = F.floor(-score * F.lit(1024)).cast("long")
    ranked = running_totals(citations, ["message_id"], step, [F.desc(score), F.asc("id")], {"position": F.lit(1).cast("long")})
    return messages.join(ranked, "message_id")


def session_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.max_by(F.coalesce("updated_at", "created_at"), "message_id").alias("updated_at"),
    )


def list_messages_asc(messages: DataFrame, limit: int = 100) -> DataFrame:
    return top_n(messages, ["session_id"], [F.asc("message_id")], limit, "position")


def current_questions(messages: DataFrame) -> DataFrame:
    """The newest user message of each session."""
    newest = messages.where(F.col("role") == "user").groupBy("session_id").agg(
        F.max_by(F.struct("message_id", "content"), "message_id").alias("q")
    )
    return newest.select("session_id", F.col("q.message_id").alias("question_id"), F.col("q.content").alias("question"))


def recent_history(
    messages: DataFrame,
    questions: DataFrame,
    fetch: int = K.HISTORY_FETCH,
    rounds: int = K.HISTORY_ROUNDS,
) -> DataFrame:
    """Clean last turns of each session, ascending by ``position``.

    The newest ``fetch`` messages are taken first; blank ones, failed assistant turns, other
    roles, the question itself and earlier user messages of equal text then drop out.
    """
    newest = top_n(messages, ["session_id"], [F.desc("message_id")], fetch, "_back")
    content = R.stripped_or_empty(F.col("content"))
    failed = (F.col("role") == "assistant") & ~F.coalesce(F.col("status").isin("SUCCESS", "success"), F.lit(True))
    repeated = (F.col("role") == "user") & (content == F.col("question"))
    clean = (
        newest.join(questions, "session_id", "left")
        .withColumn("content", content)
        .where(F.col("role").isin("user", "assistant") & (F.col("content") != "") & ~failed)
        .where(~F.coalesce(F.col("message_id") == F.col("question_id"), F.lit(False)))
        .where(~F.coalesce(repeated, F.lit(False)))
    )
    last = top_n(clean, ["session_id"], [F.desc("message_id")], rounds * 2, "_back")
    # At most six rows per session are left to renumber.
    renumbered = top_n(last.drop("_back"), ["session_id"], [F.asc("message_id")], rounds * 2, "position")
    return renumbered.select("session_id", "position", "message_id", "role", "content")


def estimate_message_tokens(messages: DataFrame) -> DataFrame:
    each = T.estimate_tokens(F.col("role")) + T.estimate_tokens(F.col("content")) + 4
    return messages.groupBy("session_id").agg(F.sum(each).alias("tokens"))
