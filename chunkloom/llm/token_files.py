"""Token files: ids ranked by frequency, in byte-aligned variable-length coding with the control bytes apart.

An id is replaced by its frequency rank (0 for the commonest), stored in 1 to 4 bytes, least significant first. Four ids share
a control byte of four 2-bit lengths. Data bytes and control bytes stand in two separate runs, so that a decoder
looks up each control byte in a table of 256 rows and moves whole arrays.

A block holds the documents of one stretch of the order: their keys, how many ids each has, control bytes, data bytes.
Blocks are rows of Parquet files, which gives splits, checks and atomic writing on any store that Spark reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.llm.common import with_running_base
from chunkloom.session import scratch_path

#: Data bytes after which a block is closed (one document is never split).
BLOCK_BYTES = 4 << 20
#: Bytes of each of the four ids of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def _present(sizes: np.ndarray) -> np.ndarray:
    """Of the places that whole control bytes have, those that hold an id; each document begins a control byte."""
    places = -(-sizes // 4) * 4
    return np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) < np.repeat(sizes, places)


def encode_ranks(ranks: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; ``sizes`` parts the numbers (below 2**32) into documents.

    In a document's last control byte absent ids count as of one byte, and have no data.
    """
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    present = _present(sizes)
    codes = np.zeros(len(present), dtype=np.uint8)
    codes[present] = length - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]].tobytes()
    ends = np.cumsum(-(-sizes // 4))
    data_ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.cumsum(sizes)]
    return _cut(control, ends), _cut(data, data_ends)


def _cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def decode_ranks(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all documents of a block, one after the other."""
    length = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[_present(sizes)]
    begin = np.cumsum(length) - length
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if len(more):
            out[more] |= raw[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def id_counts(tokens: DataFrame, ids_column: str = "ids") -> DataFrame:
    """(id, n) over all packed ids; each task counts before anything is shuffled, so the rows are bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                ids = np.frombuffer(b"".join(x or b"" for x in batch.column(0).slice(start, 1000).to_pylist()), dtype="<u4")
                found = np.bincount(ids, minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    return tokens.select(ids_column).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranked_ids(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency, then by id: at most one per entry of the vocabulary, 4 bytes each."""
    rows = id_counts(tokens).orderBy(F.desc("n"), "id").select("id").collect()
    return np.array([r[0] for r in rows], dtype=np.uint32)


def write_token_files(tokens: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write all documents of ``tokens`` (doc_id long, ids) in ascending order of doc_id, null first; equal keys follow their ids.

    Ids become ranks and are coded before the one shuffle, so that it carries about 1.5 bytes per id. It deals by ranges of the
    key, bounded by approximate quantiles of the keys alone: a sample of whole rows would code every document twice.
    The table from rank to id lies beside the blocks.
    """
    spark = tokens.sparkSession
    by_rank = ranked_ids(tokens)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spread = spark.sparkContext.broadcast(rank_of)  # 4 bytes per entry of the vocabulary
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / partitions for i in range(1, partitions)] or [0.5]
    bounds = np.unique(np.array(tokens.agg(F.percentile_approx("doc_id", shares, 100 * partitions)).head()[0] or [], dtype=np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spread.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                packed = [x or b"" for x in rows.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
                control, data = encode_ranks(table[np.frombuffer(b"".join(packed), dtype="<u4")], sizes)
                keys = rows.column(0).fill_null(-(1 << 63)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.searchsorted(bounds, keys, side="right")), pa.array(sizes), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["doc_id", "shard", "n_tokens", "control", "data"],
                )

    coded = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(code, "doc_id long, shard long, n_tokens long, control binary, data binary")
    ordered = coded.repartition(partitions, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "control", "data")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before = None, 0, 0
        keys, sizes, control, data, held = [], [], [], [], 0

        def closed():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([sum(sizes)], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary()),
                ],
                ["shard", "block", "shard_start", "n_tokens", "doc_ids", "sizes", "control", "data"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                for key, place, size, codes, coded_data in zip(*(rows.column(c).to_pylist() for c in range(5))):
                    if keys and (held >= BLOCK_BYTES or place != shard):
                        yield closed()
                        number, before = (number + 1, before + sum(sizes)) if place == shard else (0, 0)
                        keys, sizes, control, data, held = [], [], [], [], 0
                    shard, held = place, held + len(coded_data)
                    keys.append(key)
                    sizes.append(size)
                    control.append(codes)
                    data.append(coded_data)
        if keys:
            yield closed()

    blocks = ordered.mapInArrow(
        block, "shard long, block long, shard_start long, n_tokens long, doc_ids array<long>, sizes array<long>, control binary, data binary"
    )
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ids packed in 32 bits, start counts the ids of all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").head()[0], dtype="<u4")
    spread = spark.sparkContext.broadcast(by_rank)
    bases = with_running_base(blocks, "shard", "n_tokens", "base")
    placed = blocks.join(F.broadcast(bases), "shard").withColumn("at", F.col("shard_start") + F.col("base"))  # a row of 16 bytes per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sizes = batch.column("doc_ids")[row].values, batch.column("sizes")[row].values.to_numpy()
                control, data = batch.column("control")[row].as_py(), batch.column("data")[row].as_py()
                ids = spread.value[decode_ranks(control, data, sizes)].astype("<u4").tobytes()
                packed = _cut(ids, 4 * np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(batch.column("at")[row].as_py() + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(packed, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    columns = ["doc_ids", "sizes", "control", "data", "at"]
    return placed.select(*columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_path(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
