"""Packing by concatenation: running sums over partition totals place every token, fixed windows cut the stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import fresh, give_back, with_running_base
from chunkloom.llm.tokens import library_encoder
from chunkloom.session import written

SEQUENCE = 1024


def tokenized(docs: DataFrame, path: str, end_id: int | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids): packed 32-bit ids, and how many lie before them in the same partition.

    Null and empty texts hold the end id alone (nothing, if there is none). Rows that repeat stay apart.
    """
    tail = b"" if end_id is None else np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder, part, before = library_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                ids = [found + tail for found in encoder.encode([t or "" for t in rows.column(1).to_pylist()])]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part long, part_start long, n_tokens long, ids binary")


def pack(tokens: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Cut the stream of all tokens into sequences of ``length``; one row per piece of a document inside one sequence.

    ``tokens`` is a stored table of :func:`tokenized`. First pass: totals by partition and their running sum,
    which turns a place inside a partition into a place in the whole stream. Second pass: each document is cut where a
    multiple of ``length`` falls into it. A document that crosses a border gives one record on each side of it
    (``crosses`` tells so), so that every sequence can be put together from its records alone. Only the last sequence
    can be short. Documents without tokens give no record.
    Returns doc_id, start, length, ids (packed 32-bit), doc_tokens, sequence_id, offset, crosses.
    """
    if length < 1:
        raise ValueError("a sequence holds one token at least")
    bases = with_running_base(tokens, "part", "n_tokens", "base")
    # One row of 16 bytes per partition of the tokenizing job: about 13 MB for 100 TB in splits of 128 MB.
    placed = tokens.where("n_tokens > 0").join(F.broadcast(bases), "part").withColumn("at", F.col("part_start") + F.col("base"))
    # Cut without Python workers: those of the tokenizing job still hold their memories, and texts would go through both sides again.
    windows = F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n_tokens - 1) div {length}"))
    cut = placed.select("doc_id", "at", "n_tokens", "ids", F.explode(windows).alias("sequence_id"))
    begin, end = F.greatest(F.col("sequence_id") * length, "at"), F.least((F.col("sequence_id") + 1) * length, F.col("at") + F.col("n_tokens"))
    start, size = begin - F.col("at"), end - begin
    return cut.select(
        "doc_id", start.alias("start"), size.alias("length"), F.substring("ids", (4 * start + 1).cast("int"), (4 * size).cast("int")).alias("ids"),
        F.col("n_tokens").alias("doc_tokens"), "sequence_id", (begin - F.col("sequence_id") * length).alias("offset"), (size < F.col("n_tokens")).alias("crosses"),
    )


def padded_length(used: int, length: int = SEQUENCE) -> int:
    """Places that a sequence takes: ``length``, unless it holds a power of two of tokens and needs no padding."""
    return used if used > 0 and used & (used - 1) == 0 else length


def sequences(pieces: DataFrame, length: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, input_ids (padded), n_used. A sequence has at most ``length`` pieces."""

    def build(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["offset"], r["ids"], r["sequence_id"]) for batch in group for r in batch.select(["offset", "ids", "sequence_id"]).to_pylist())
        ids = np.frombuffer(b"".join(r[1] for r in rows), dtype="<u4").astype(np.int32)
        full = np.full(padded_length(len(ids), length), pad_id, dtype=np.int32)
        full[: len(ids)] = ids
        yield pa.RecordBatch.from_pydict(
            {"sequence_id": pa.array([rows[0][2]], pa.int64()), "input_ids": pa.array([full.tolist()], pa.list_(pa.int32())), "n_used": pa.array([len(ids)], pa.int64())}
        )

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(build, "sequence_id long, input_ids array<int>, n_used long")


def packed_documents(docs: DataFrame, path: str, end_id: int | None = 0, length: int = SEQUENCE) -> DataFrame:
    """Tokenize, store and pack; the stored ids are the only copy that is kept."""
    return pack(written(tokenized(docs, path, end_id), "tokens", compression="zstd"), length)


def checksums(pieces: DataFrame, source: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """crc32 of packed ids as a column, in place of the ids."""
    out = fresh([c for c in pieces.columns if c != source], out)
    return pieces.withColumn(out, F.crc32(source)).drop(source)
