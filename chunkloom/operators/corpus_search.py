"""Exact inner-product search over all documents of a corpus at once.

The index deals vectors out to the nearest of a few pivots and cuts each pivot's share into blocks; a block knows its centroid and radius. No
vector of a block scores more than ``query . centroid + |query| * radius``. A search takes three steps:

1. The directory (centroids and radii, packed into pages) gives each query its few most promising blocks. They are scored, and the
   k-th score found there is the query's floor.
2. The directory again: blocks whose bound lies below the floors of all queries are left out.
3. The other blocks meet the queries as matrix products, for those queries only whose bound reaches their floor, which rises as
   a task goes from block to block. Each task hands on about k hits for a query; the best of them are ranked.

Pivots are a bounded sample and decide only how much can be left out; every vector is in a block and results are exact. A (query, vector)
pair is never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.operators.ranking import top_n
from chunkloom.operators.retrieval import BROADCAST_QUERY_BYTES, QUERY_BLOCK, SALTS, SCORE_DIGITS, VECTOR_BLOCK
from chunkloom.session import written

#: Vectors that the others are dealt out to, taken by a hash of the id.
PIVOTS = 256
#: Blocks that are scored first for each query.
PROBES = 2
#: Centroids of a page of the directory.
PAGE = 1024
#: Ranks are decided after rounding, so everything within a rounding step of a floor stays in.
SLACK = 2.0 * 10.0**-SCORE_DIGITS

INDEX = "block long, size long, centroid array<double>, radius double, chunk_ids array<long>, doc_ids array<long>, matrix array<float>"
HITS = "query_id long, doc_id long, chunk_id long, raw double"


def _rows(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_index(vectors: DataFrame, pivots: int = PIVOTS, block: int = VECTOR_BLOCK) -> DataFrame:
    """Blocks of about ``block`` vectors (chunk_id, doc_id, embedding) near each other, with centroid and radius; stored.

    Rows without a vector are left out. A pivot with a large share of all vectors gets as many blocks as it needs.
    """
    known = vectors.where("embedding is not null and size(embedding) > 0").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    sample = np.array([r[0] for r in known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).select("embedding").collect()], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast(sample)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        half = (own * own).sum(axis=1) / 2
        for batch in batches:
            cells = np.argmax(_rows(batch.column("embedding")) @ own.T - half, axis=1) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], [*batch.schema.names, "cell"])

    celled = written(known.mapInArrow(near, "chunk_id long, doc_id long, embedding array<float>, cell long"), "celled-vectors")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("pieces"))
    # At most one row for each pivot.
    dealt = celled.join(F.broadcast(sizes), "cell")
    dealt = dealt.withColumn("block", F.shiftleft("cell", 40) + F.pmod(F.xxhash64("chunk_id"), F.col("pieces"))).select("block", "chunk_id", "doc_id", "embedding")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id").combine_chunks()
        x = _rows(table.column("embedding").combine_chunks())
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        one = {
            "block": table.column("block")[0].as_py(), "size": len(x), "centroid": centre, "radius": radius, "chunk_ids": table.column("chunk_id").to_numpy(),
            "doc_ids": table.column("doc_id").to_pylist(), "matrix": x.astype(np.float32).ravel(),
        }
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float32())]
        return pa.table([pa.array([v], k) for v, k in zip(one.values(), kinds)], names=list(one))

    return written(dealt.groupBy("block").applyInArrow(pack, INDEX), "corpus-index")


def _packed_queries(queries: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key with its queries (some ``QUERY_BLOCK``), their vectors and floors."""
    packed = queries.groupBy(*keys).agg(F.collect_list(F.struct("query_id", "embedding", "floor")).alias("q"))
    return packed.select(
        *keys, F.transform("q", lambda x: x["query_id"]).alias("query_ids"), F.flatten(F.transform("q", lambda x: x["embedding"])).alias("query_matrix"),
        F.transform("q", lambda x: x["floor"]).alias("floors"),
    )


def _meet(left: DataFrame, key: str, query_blocks: DataFrame, few: bool) -> DataFrame:
    """Each row of ``left`` next to each query block: a bounded broadcast, or both sides dealt out by a salt."""
    salts = 1 if few else SALTS
    salted = left.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    spread = query_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(F.broadcast(spread) if few else spread, "salt").drop("salt")


def _cell(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _queries_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _cell(batch, "query_ids", i)
    q = _cell(batch, "query_matrix", i).astype(np.float64).reshape(len(ids), -1)
    return ids, q, _cell(batch, "floors", i)


def _bounds(batch: pa.RecordBatch, i: int, q: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block of a page; a little more, against rounding in the sums."""
    radius = _cell(batch, "radii", i)
    centres = _cell(batch, "centroids", i).reshape(len(radius), -1)
    norms = np.sqrt((q * q).sum(axis=1))
    bound = q @ centres.T + norms[:, None] * radius[None, :]
    return bound + 1e-9 * (1 + norms[:, None] * (radius + np.sqrt((centres * centres).sum(axis=1)))[None, :])


def _pages(index: DataFrame) -> DataFrame:
    blocks = index.count()
    page = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks // PAGE)))).cast("int")
    packed = index.groupBy(page.alias("page")).agg(F.collect_list(F.struct("block", "centroid", "radius")).alias("b"))
    return packed.select(
        "page", F.transform("b", lambda x: x["block"]).alias("blocks"), F.flatten(F.transform("b", lambda x: x["centroid"])).alias("centroids"),
        F.transform("b", lambda x: x["radius"]).alias("radii"),
    )


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, q, _ = _queries_of(batch, i)
            bound, blocks = _bounds(batch, i, q), _cell(batch, "blocks", i)
            n = min(PROBES, len(blocks))
            best = np.argpartition(-bound, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(blocks[best].ravel()), pa.array(np.take_along_axis(bound, best, axis=1).ravel())], ["query_id", "block", "bound"]
            )


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            _, q, floors = _queries_of(batch, i)
            alive = _bounds(batch, i, q) >= floors[:, None] - SLACK
            needed = _cell(batch, "blocks", i)[alive.any(axis=0)]
            columns = [pa.array([alive.size], pa.int64()), pa.array([int(alive.sum())], pa.int64()), pa.array([needed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["pairs", "alive", "needed"])


def _best_of_blocks(k: int):
    """One matrix product for each pair of query block and vector block, for the queries whose bound reaches their floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, q, floor = _queries_of(batch, i)
                floor = floors.setdefault((batch.column("query_block")[i].as_py(), len(ids)), floor.copy())
                centre, radius = _cell(batch, "centroid", i), batch.column("radius")[i].as_py()
                norms = np.sqrt((q * q).sum(axis=1))
                bound = q @ centre + norms * radius
                alive = np.flatnonzero(bound + 1e-9 * (1 + norms * (radius + np.sqrt(centre @ centre))) >= floor - SLACK)
                if not len(alive):
                    continue
                chunks, docs = _cell(batch, "chunk_ids", i), batch.column("doc_ids")[i].values
                scores = q[alive] @ _cell(batch, "matrix", i).astype(np.float64).reshape(len(chunks), -1).T
                if len(chunks) >= k:
                    floor[alive] = np.maximum(floor[alive], -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                row, column = np.nonzero(scores >= floor[alive][:, None] - SLACK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[alive[row]], pa.int64()), docs.take(pa.array(column)), pa.array(chunks[column], pa.int64()), pa.array(scores[row, column], pa.float64())],
                    ["query_id", "doc_id", "chunk_id", "raw"],
                )

    return search


def _first_floors(asked: DataFrame, index: DataFrame, pages: DataFrame, k: int, few: bool) -> DataFrame:
    """Queries with their k-th score in the most promising blocks as ``floor``; without limit where those hold fewer vectors."""
    no_floor = asked.withColumn("floor", F.lit(float("-inf")))
    found = _meet(pages, "page", _packed_queries(no_floor, ["query_block"]), few).mapInArrow(_promising, "query_id long, block long, bound double")
    seeds = top_n(found, ["query_id"], [F.desc("bound"), F.asc("block")], PROBES).select("query_id", "block")
    wanted = _packed_queries(no_floor.join(seeds, "query_id"), ["block", "query_block"])
    scored = index.join(wanted, "block").mapInArrow(_best_of_blocks(k), HITS)
    # A query has about k scores from each of its few blocks.
    kth = scored.groupBy("query_id").agg(F.sort_array(F.collect_list("raw"), asc=False).alias("best"))
    kth = kth.select("query_id", F.try_element_at("best", F.lit(k)).alias("floor"))
    return asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))


def search_corpus(queries: DataFrame, index: DataFrame, k: int, broadcast_bytes: int = BROADCAST_QUERY_BYTES) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` vectors of the whole index for each query (query_id, embedding), and how much was left out.

    Hits are (query_id, doc_id, chunk_id, score, rank): scores are rounded to six digits first, ties go to the lower chunk id. The second
    table has one row: ``pairs`` of queries and blocks, and ``alive``, those that the bounds did not rule out. Queries without a
    vector find nothing; query ids are taken to be unique.
    """
    asked = queries.where("embedding is not null and size(embedding) > 0").select("query_id", "embedding")
    size, count = asked.agg(F.sum(F.size("embedding") * 4 + 24), F.count(F.lit(1))).head()
    few = (size or 0) <= broadcast_bytes
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-count // QUERY_BLOCK)))).cast("int"))
    pages = written(_pages(index.select("block", "centroid", "radius")), "directory")
    floored = written(_first_floors(asked, index, pages, k, few), "floors")
    blocks = _packed_queries(floored, ["query_block"])
    tested = written(_meet(pages, "page", blocks, few).mapInArrow(_surviving, "pairs long, alive long, needed array<long>"), "bounds")
    needed = tested.select(F.explode("needed").alias("block")).distinct()
    hits = _meet(index.join(needed, "block", "left_semi"), "block", blocks, few).mapInArrow(_best_of_blocks(k), HITS)
    hits = hits.select("query_id", "doc_id", "chunk_id", F.round("raw", SCORE_DIGITS).alias("score"))
    return top_n(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k), tested.agg(F.sum("pairs").alias("pairs"), F.sum("alive").alias("alive"))
