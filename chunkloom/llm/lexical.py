"""Ranked lexical search of many items at once, by bag deduplication.

Documents are restricted to the items' vocabulary: of each stay its length and the packed (term number, frequency) pairs. Documents whose
pairs and length factor ``m`` are identical get the same score for every item, so they form a class (grouped by hash, told apart by the
bytes themselves). Each class is scored once; the members of the classes that can be among the first ``k`` come in by ascending id.

A class is known by its smallest id. Ten classes, ordered by (score, smallest id), always hold the ten first documents: each class that is
left out has ten documents before all of its own.

The statistics (documents, terms, documents with a term) are counted over all documents. Items go through in groups of at most
``GROUP_BYTES`` of terms, measured first, so that what is sent to the workers is bounded; usually there is one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.llm.common import terms
from chunkloom.session import written

FIRST = 10
#: Bytes of the item terms that workers hold at a time.
GROUP_BYTES = 16_000_000
#: Scores of a block of classes held at a time, and products of them made at a time.
SCORES, PRODUCTS = 2_000_000, 1_000_000


def item_terms(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(item, term, times): terms of each item with their repeats, over all rows of the item. Rows without an item id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                said = terms(text)
                item = pa.DictionaryArray.from_arrays(pa.array([0] * len(said), pa.int32()), batch.column("item").slice(i, 1)).dictionary_decode()
                yield pa.RecordBatch.from_arrays([item, pa.array(said, pa.binary())], ["item", "term"])

    rows = items.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").cast("binary").alias("text")).where("item is not null")
    found = rows.mapInArrow(run, rows.schema.fields[0].dataType.simpleString().join(["item ", ", term binary"]))
    return found.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def bags(docs: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, bag): terms of each document with repeats, and its packed term numbers followed by their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})
    width = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column("text"):
                said = terms(text.as_py())
                sizes.append(len(said))
                own = [numbers[t] for t in said if t in numbers]
                counts = np.bincount(own) if len(own) > width // 8 else None
                if counts is not None:
                    kinds = np.flatnonzero(counts)
                    counts = counts[kinds]
                else:
                    kinds, counts = np.unique(np.array(own, dtype=np.int64), return_counts=True)
                packed.append(kinds.astype("<u4").tobytes() + counts.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def document_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term; a task hands on one count for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                total[np.frombuffer(bag, dtype="<u4", count=len(bag) // 8)] += 1
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    out = np.zeros(width, dtype=np.int64)
    for term, n in rows.select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def term_weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], dtype=np.int64)


def length_factor(documents: int, total: int) -> str:
    """SQL for m of a document of n terms."""
    return f"100 - 75 + (75 * n * {documents}L) div {total}L"


class Items:
    """The items of a group as a sparse matrix, term by item."""

    def __init__(self, size: int, rows: list[tuple[int, int, int]], width: int, weights: np.ndarray):
        item, term, times = (np.array(c, dtype=np.int64) for c in zip(*rows))
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.begins = np.searchsorted(term[order], np.arange(width + 1))
        self.weights, self.size = weights, size

    def scores(self, m: np.ndarray, bags: list[bytes]) -> np.ndarray:
        """Classes by items."""
        numbers = [np.frombuffer(b, dtype="<u4") for b in bags]
        kinds = np.array([len(x) // 2 for x in numbers])
        term = np.concatenate([x[:k] for x, k in zip(numbers, kinds)]).astype(np.int64)
        tf = np.concatenate([x[k:] for x, k in zip(numbers, kinds)]).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), kinds)
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        held = self.begins[term + 1] - self.begins[term]
        out = np.zeros(len(bags) * self.size, dtype=np.int64)
        ends = np.cumsum(held)
        start = 0
        while start < len(term):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PRODUCTS, side="right")))
            n = held[start:end]
            at = np.repeat(self.begins[term[start:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.add.at(out, np.repeat(row[start:end], n) * self.size + self.item[at], np.repeat(part[start:end], n) * self.times[at])
            start = end
        return out.reshape(len(bags), self.size)


def _first_of(score: np.ndarray, first: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score, smallest id) of each item."""
    order = np.lexsort((first, -score, item))
    begins = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - begins < k]


def best_classes(classes: DataFrame, items: Items, k: int) -> DataFrame:
    """(item_number, key, m, first_id, score): of each task the k best classes of each item, from (key, m, bag, first_id)."""
    shared = classes.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        kept = [np.zeros(0, dtype=np.int64) for _ in range(5)]  # item, score, first id, key, m
        floor = np.ones(items.size, dtype=np.int64)
        step = max(1, SCORES // items.size)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                m, key, first = (part.column(c).to_numpy() for c in ("m", "key", "first_id"))
                scores = items.scores(m, part.column("bag").to_pylist())
                row, item = np.nonzero(scores >= floor)
                new = [item, scores[row, item], first[row], key[row], m[row]]
                kept = [np.concatenate(pair) for pair in zip(kept, new)]
                best = _first_of(kept[1], kept[2], kept[0], k)
                kept = [column[best] for column in kept]
                count = np.bincount(kept[0], minlength=items.size)
                last = np.cumsum(count) - 1
                full = count == k
                floor[full] = kept[1][last[full]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], ["item_number", "score", "first_id", "key", "m"])

    return classes.select("key", "m", "bag", "first_id").mapInArrow(run, "item_number long, score long, first_id long, key long, m long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = FIRST, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", group_bytes: int | None = None,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the first ``k`` documents with a score above 0 of each item, ties by ascending doc_id.

    Null texts have no terms. Documents without an id count in the statistics and are not returned; each row is a document, so repeated
    rows can follow each other with one id. Rows of ``items`` that share an id are one item; those without an id are left out. Columns beside
    the four named are not looked at. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items, item_column, item_text_column), "item-terms")
    size = wanted.agg(F.sum(F.octet_length("term") + 24)).head()[0] or 0
    groups = max(1, -(-size // (group_bytes or GROUP_BYTES)))
    kind = wanted.schema["item"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for group in range(groups if size else 0):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).collect()
        if rows:
            out = out.union(_of_group(docs, rows, kind, k, id_column, text_column))
    return out


def _of_group(docs: DataFrame, rows: list, kind, k: int, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({bytes(r.term) for r in rows})
    names = sorted({r["item"] for r in rows})
    number, item_number = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(names)}
    held = written(bags(docs, vocabulary, id_column, text_column), "bags", compression="zstd")
    documents, total = held.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    total = total or 1  # no document has a term: nothing is scored
    weights = term_weights(documents, document_counts(held, len(vocabulary)))
    matrix = Items(len(names), [(item_number[r["item"]], number[bytes(r.term)], r.times) for r in rows], len(vocabulary), weights)
    known = held.where("doc_id is not null and octet_length(bag) > 0").withColumn("m", F.expr(length_factor(documents, total)))
    known = known.withColumn("key", F.xxhash64("m", "bag"))
    classes = known.groupBy("key", "m", "bag").agg(F.min("doc_id").alias("first_id"))
    best = best_classes(classes, matrix, k)
    of_item = Window.partitionBy("item_number").orderBy(F.desc("score"), "first_id")
    best = written(best.withColumn("_at", F.row_number().over(of_item)).where(F.col("_at") <= k).drop("_at"), "best-classes")
    # At most k keys for each item of the group.
    members = known.join(F.broadcast(best.select("key").distinct()), "key", "left_semi")
    of_class = Window.partitionBy("key", "m", "bag").orderBy("doc_id")
    members = members.withColumn("_at", F.row_number().over(of_class)).where(F.col("_at") <= k)
    members = members.withColumn("first_id", F.min("doc_id").over(of_class.rowsBetween(Window.unboundedPreceding, 0))).select("key", "m", "first_id", "doc_id")
    of_item = Window.partitionBy("item_number").orderBy(F.desc("score"), "doc_id")
    found = members.join(best, ["key", "m", "first_id"]).withColumn("rank", F.row_number().over(of_item)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(names)), f"item_number long, item_id {kind.simpleString()}")
    return found.join(F.broadcast(names), "item_number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
