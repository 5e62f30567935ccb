"""Model call points. Real models plug in as batch functions; the default needs no download."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import text as T

#: Words whose slots a task remembers.
REMEMBERED_WORDS = 200_000
EmbedBatch = Callable[[list[str]], np.ndarray]


def hashing_model(dim: int = 64) -> Callable[[], EmbedBatch]:
    """Signed feature hashing of lower-case words into ``dim`` slots, unit length. Slot and sign come from the word's md5."""

    def load() -> EmbedBatch:
        known: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            if word not in known:
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                h = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)
                known[word] = h % dim, 1.0 if (h >> 16) & 1 else -1.0
            return known[word]

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype="float32")
            for i, text in enumerate(texts):
                places = [place(word) for word in text.lower().split()]
                if places:
                    slots, signs = zip(*places)
                    out[i] = np.bincount(slots, weights=signs, minlength=dim)
            norms = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return out / norms

        return embed

    return load


def _embed_column(load: Callable[[], EmbedBatch], batch_size: int):
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = batch.tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                vectors = np.asarray(model(part), dtype="float32")
                if vectors.ndim != 2:
                    raise ValueError("embedding result must be 2-D")
                if len(vectors) != len(part):
                    raise ValueError(f"embedding count mismatch: expected {len(part)}, got {len(vectors)}")
                rows.extend(vectors)
            yield pd.Series(rows)

    return embed


def embed_chunks(
    chunks: DataFrame,
    load: Callable[[], EmbedBatch] | None = None,
    prefix: str = "",
    batch_size: int = K.EMBEDDING_BATCH,
    text: str = "content",
) -> DataFrame:
    """Add ``embedding``; the model is loaded once per task and sees batches."""
    udf = _embed_column(load or hashing_model(), batch_size)
    return chunks.withColumn("embedding", udf(T.prefixed(prefix, F.col(text))))


def embed_queries(
    queries: DataFrame,
    load: Callable[[], EmbedBatch] | None = None,
    prefix: str = "",
    batch_size: int = K.EMBEDDING_BATCH,
    text: str = "question",
) -> DataFrame:
    """As :func:`embed_chunks`, but a blank question stops the job."""
    body = T.collapse_whitespace(F.col(text))
    checked = F.when(body != "", F.col(text)).otherwise(F.raise_error(F.lit("query text is empty")))
    return embed_chunks(queries.withColumn(text, checked), load, prefix, batch_size, text)


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.split(T.strip(F.lower(F.coalesce(text, F.lit("")))), rf"{T.WS}+"))


def overlap_score(asked: Column, words: Column) -> Column:
    """Share of the asked words found, 6 digits."""
    found = F.size(F.array_intersect(words, asked))
    return F.round(found.cast("double") / F.size(asked), 6)


def token_overlap(candidates: DataFrame, questions: DataFrame, contents: DataFrame) -> DataFrame:
    """Default scorer of (query_id, chunk_id) candidates: adds ``rerank_score``.

    Each question and each chunk is split into words once; the pairs only compare the sets.
    The short question words travel with the candidates to the chunk's words, not the reverse.
    """
    asked = questions.select("query_id", word_set(F.col("question")).alias("_asked"))
    words = contents.select("chunk_id", word_set(F.col("content")).alias("_words"))
    pairs = candidates.join(asked, "query_id").join(words, "chunk_id")
    return pairs.withColumn("rerank_score", overlap_score(F.col("_asked"), F.col("_words"))).drop("_asked", "_words")


def rerank_with_model(
    load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch_size: int = K.RERANK_BATCH
) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """A scorer like :func:`token_overlap` from a model called in batches on (question, content)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, contents in batches:
            both = list(zip(questions, contents))
            values: list[float] = []
            for start in range(0, len(both), batch_size):
                part = both[start : start + batch_size]
                got = np.asarray(model(part), dtype="float64").reshape(-1)
                if len(got) != len(part):
                    raise ValueError(f"reranker count mismatch: expected {len(part)}, got {len(got)}")
                values.extend(got)
            yield pd.Series(values)

    def scorer(candidates: DataFrame, questions: DataFrame, contents: DataFrame) -> DataFrame:
        asked = candidates.join(questions.select("query_id", "question"), "query_id")
        pairs = asked.join(contents.select("chunk_id", "content"), "chunk_id")
        scored = pairs.withColumn("rerank_score", F.round(score("question", "content"), 6))
        return scored.drop("question", "content")

    return scorer
