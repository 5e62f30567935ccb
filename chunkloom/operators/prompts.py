"""Context blocks, prompts, previews and template answers as ordered text aggregates.

Every list aggregated here holds the hits or messages of one question, which the
retrieval and history limits have already cut to a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import text as T
from chunkloom.functions.records import stripped_or_empty


def four_digits(value: Column) -> Column:
    return value.cast("decimal(18,6)").cast("decimal(18,4)").cast("string")


def plain_float(value: Column) -> Column:
    """Shortest text of a number with at most six decimals, as float text reads in Python."""
    fixed = value.cast("decimal(18,6)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ".0")
    micro = F.round(F.abs(value) * 1e6).cast("int")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    tenths = micro % 10
    small = (
        F.when(micro < 10, F.concat(sign, micro.cast("string"), F.lit("e-06")))
        .when(tenths == 0, F.concat(sign, (micro / 10).cast("int").cast("string"), F.lit("e-05")))
        .otherwise(F.concat(sign, F.floor(micro / 10).cast("string"), F.lit("."), tenths.cast("string"), F.lit("e-05")))
    )
    return F.when((micro > 0) & (micro < 100), small).otherwise(trimmed)


def chunk_header(rank: Column) -> Column:
    """``[Chunk n]`` and the known facts of a hit, separated by bars."""
    named = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(label + "="), value))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("[Chunk "), rank.cast("string"), F.lit("]")),
        named("doc_id", F.col("doc_id").cast("string")),
        named("chunk_index", F.col("chunk_index").cast("string")),
        named("score", four_digits(F.col("score"))),
        named("rerank_score", four_digits(F.col("rerank_score"))),
        named("original_rank", F.col("original_rank").cast("string")),
    )


def _ordered_join(key: str, line: Column, separator: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    return F.array_join(F.transform(items, lambda x: x["line"]), separator)


def context_blocks(context: DataFrame, max_chars: int = K.CONTEXT_CHUNK_CHARS) -> DataFrame:
    """Context text per query with the second truncation."""
    block = F.concat(chunk_header(F.col("rank")), F.lit("\n"), T.truncate_prompt(F.col("content"), max_chars))
    text = T.strip(_ordered_join("rank", block, "\n\n"))
    return context.groupBy("query_id").agg(text.alias("context_text"), F.count("*").alias("context_count"))


def _fill(template: str, *values: Column) -> Column:
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for value, tail in zip(values, pieces[1:]):
        out += [value, F.lit(tail)]
    return F.concat(*out)


def build_prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, question, mode) plus its context to system and user prompt."""
    joined = questions.join(context_blocks(context), "query_id", "left")
    asked = stripped_or_empty(F.col("question"))
    block = F.coalesce("context_text", F.lit(""))
    nothing = F.col("mode") == "no_context"
    user = (
        F.when(nothing, _fill(K.NO_CONTEXT_PROMPT, asked))
        .when(F.col("mode") == "low_confidence", _fill(K.LOW_CONFIDENCE_PROMPT, block, asked))
        .otherwise(_fill(K.NORMAL_PROMPT, block, asked))
    )
    system = F.lit(K.SYSTEM_INSTRUCTION)
    return joined.select(
        "query_id",
        "mode",
        F.when(nothing, F.lit(0)).otherwise(F.coalesce("context_count", F.lit(0))).cast("long").alias("context_count"),
        system.alias("system_prompt"),
        user.alias("user_prompt"),
    )


def prompt_messages(prompts: DataFrame) -> DataFrame:
    message = lambda role, name: F.struct(F.lit(role).alias("role"), F.col(name).alias("content"))
    return prompts.select(
        "query_id", F.array(message("system", "system_prompt"), message("user", "user_prompt")).alias("messages")
    )


def history_retrieval_text(context: DataFrame) -> DataFrame:
    """Retrieval text of the multi-turn prompt: blank hits skipped, no second truncation."""
    body = stripped_or_empty(F.col("content"))
    block = F.concat(chunk_header(F.col("rank")), F.lit("\n"), body)
    joined = _ordered_join("rank", block, "\n\n")
    return (
        context.where(body != "")
        .groupBy("query_id")
        .agg(F.concat(F.lit(K.HISTORY_RETRIEVAL_HEADER), joined).alias("retrieval_text"))
    )


def build_chat_messages(
    questions: DataFrame, history: DataFrame, context: DataFrame, system_prompt: str = K.SYSTEM_INSTRUCTION
) -> DataFrame:
    """System prompt, recent turns, retrieval text if any, then the question.

    ``questions``: (query_id, session_id, question); ``history``: (session_id, position, role, content).
    """
    message = lambda role, body: F.struct(F.lit(role).alias("role"), body.alias("content"))
    turns = F.array_sort(F.collect_list(F.struct("position", "role", "content")))
    past = history.groupBy("session_id").agg(
        F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("turns")
    )
    joined = questions.join(past, "session_id", "left").join(history_retrieval_text(context), "query_id", "left")
    kind = "array<struct<role:string,content:string>>"
    none = F.array().cast(kind)
    retrieval = F.when(
        F.col("retrieval_text").isNotNull(), F.array(message("system", F.col("retrieval_text"))).cast(kind)
    ).otherwise(none)
    return joined.select(
        "query_id",
        F.concat(
            F.array(message("system", F.lit(system_prompt))).cast(kind),
            F.coalesce("turns", none).cast(kind),
            retrieval,
            F.array(message("user", F.col("question"))).cast(kind),
        ).alias("messages"),
    )


def prompt_preview(messages: Column) -> Column:
    """Numbered one-line messages, each and the whole cut."""
    one_line = lambda m: F.replace(F.coalesce(m["content"], F.lit("")), F.lit("\n"), F.lit("\\n"))
    short = lambda c: F.when(F.char_length(c) <= K.PREVIEW_MESSAGE_CHARS, c).otherwise(
        F.concat(T.left(c, K.PREVIEW_MESSAGE_CHARS), F.lit("...(truncated)"))
    )
    line = lambda m, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] role="), F.coalesce(m["role"], F.lit("")), F.lit(" content="), short(one_line(m))
    )
    text = F.array_join(F.transform(messages, line), "\n")
    return F.when(F.char_length(text) <= K.PREVIEW_TOTAL_CHARS, text).otherwise(
        F.concat(T.left(text, K.PREVIEW_TOTAL_CHARS), F.lit("\n...(prompt preview truncated)"))
    )


def template_answer(questions: DataFrame, context: DataFrame) -> DataFrame:
    """Extractive answer that lists every hit."""
    body = stripped_or_empty(F.coalesce(F.nullif("snippet", F.lit("")), F.col("content")))
    shown = lambda text: F.coalesce(text, F.lit("None"))
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". [chunk_index="), shown(F.col("chunk_index").cast("string")),
        F.lit(", score="), shown(plain_float(F.col("score"))), F.lit("] "), body,
    )
    lines = context.groupBy("query_id").agg(_ordered_join("rank", line, "\n").alias("lines"))
    full = F.concat_ws("\n", _fill(K.TEMPLATE_ANSWER_HEAD, F.col("question")), F.col("lines"), F.lit(K.TEMPLATE_ANSWER_TAIL))
    return questions.join(lines, "query_id", "left").select(
        "query_id",
        F.when(F.col("lines").isNull(), _fill(K.TEMPLATE_ANSWER_EMPTY, F.col("question"))).otherwise(full).alias("answer"),
    )


def fallback_answer(questions: DataFrame, context: DataFrame, hits: int = 3, chars: int = 200) -> DataFrame:
    """Short extractive answer from the first hits."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), T.truncate_hit(stripped_or_empty(F.col("content")), chars)
    )
    lines = context.where(F.col("rank") <= hits).groupBy("query_id").agg(_ordered_join("rank", line, "\n").alias("lines"))
    full = F.concat_ws(
        "\n",
        F.lit(K.FALLBACK_ANSWER_HEAD), F.lit(""),
        _fill(K.FALLBACK_ANSWER_QUESTION, stripped_or_empty(F.col("question"))), F.lit(""),
        F.lit(K.FALLBACK_ANSWER_LIST), F.col("lines"), F.lit(""), F.lit(K.FALLBACK_ANSWER_TAIL),
    )
    return questions.join(lines, "query_id", "left").select(
        "query_id", F.when(F.col("lines").isNull(), F.lit(K.FALLBACK_ANSWER_EMPTY)).otherwise(full).alias("answer")
    )


def answer_source(results: DataFrame, fallback: bool = True) -> DataFrame:
    """Where an answer comes from, given (mode, model_answer, model_error)."""
    ok = F.col("model_error").isNull() & F.col("model_answer").isNotNull()
    source = (
        F.when(F.col("mode") == "no_context", F.lit("no_context"))
        .when(ok, F.lit("llm"))
        .otherwise(F.lit("mock_fallback") if fallback else F.lit("error"))
    )
    routed = results.withColumn("answer_source", source)
    text = (
        F.when(F.col("answer_source") == "no_context", F.lit(K.NO_CONTEXT_ANSWER))
        .when(F.col("answer_source") == "llm", F.col("model_answer"))
        .when(F.col("answer_source") == "mock_fallback", F.col("fallback_answer"))
    )
    return routed.withColumn("answer", text)
