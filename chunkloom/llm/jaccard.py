"""Jaccard join of documents by word n-grams, as a blocked product of the sparse document by n-gram matrix with its transpose.

The matrix is cut into row blocks (documents of one stretch of the input) and column blocks (n-grams by hash), and moved
as packed arrays, one row per block. Three kinds of bound thin it out before anything is multiplied, and none loses a pair:

1. A column with one entry adds nothing to any overlap. A document of n n-grams with fewer than ceil(t n) entries in
   shared columns cannot reach similarity t with anything and leaves.
2. Documents with equal sets become one row.
3. With the rarest columns first, two rows that reach t share one of their first n - ceil(t n) + 1 columns. Columns with few
   such entries give pairs, which sizes and places bound once more before their overlaps are counted. Rows that meet in
   columns with many entries (a large group of near copies, a passage of half the corpus) are put into one group,
   cut into chunks, and multiplied chunk by chunk inside the tasks, so that no list of pairs is written.

Links join documents whose overlap reaches t of their union; classes are the connected components.
An n-gram is told by its column block and 40 bits of its hash; blocks hold about ``COLUMN_BLOCK`` entries whatever the input, so
that about one entry in a million shares its number with another n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import LOWER, mix, powers, shingles, text_slices, word_hashes, words
from chunkloom.llm.components import components
from chunkloom.session import written

WORDS = 5
#: Links from 75 hundredths on.
PERCENT = 75
#: Entries of a row block (as far as whole documents allow) and of a column block. On executors with more memory larger blocks move fewer, longer arrays.
ROW_BLOCK, COLUMN_BLOCK = 1_000_000, 1_000_000
#: Entries of the first columns up to which a column gives pairs; beyond, its rows are multiplied in chunks.
SPARSE_COLUMN = 64
CHUNK = 256
#: A column with so many rows in one row block is one weighted entry of that block on its way to the column's count; its rows stay with the block.
DENSE = 32
#: Entries of a chunk, on average at most.
CHUNK_ENTRIES = 500_000
#: Entries of a chunk that are multiplied at a time.
PRODUCT_ENTRIES = 400_000
LOW_40 = np.uint64((1 << 40) - 1)


def least_overlap(sizes, percent: int = PERCENT):
    """Entries that a set of this size must share with any partner: ceil(t n)."""
    return -(-sizes * percent // 100)


def linked(overlap, total, percent: int = PERCENT):
    """Whether sets of ``total`` entries together (each counted by itself) and this overlap are linked."""
    return (100 + percent) * overlap >= percent * total


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, n-gram hash) of about 1 MB of texts: distinct, sorted by row and hash. A-Z are lowered.

    A text of fewer than ``n`` words has its whole sequence as its only n-gram; without words it has none.
    """
    for first, data, offsets in text_slices(column):
        rows = len(offsets) - 1
        data = LOWER[data]
        starts, ends, owner = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        grams, gram_owner = shingles(hashes, owner, n)
        counts = np.bincount(owner, minlength=rows)
        begins = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            total = counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            for j, factor in enumerate(powers(0xE7037ED1A0B428DB, n + 1)[1:]):
                has = counts[short] > j
                total[has] += hashes[begins[short[has]] + j] * factor
            grams, gram_owner = np.concatenate([grams, mix(total)]), np.concatenate([gram_owner, short])
        order = np.lexsort((grams, gram_owner))
        grams, gram_owner = grams[order], gram_owner[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (gram_owner[1:] != gram_owner[:-1])
        yield first, rows, gram_owner[new], grams[new]


def _five_bytes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


#: Row numbers from here on stand for a block's dense columns.
MARK = 1 << 31
BLOCKS = "block long, bucket int, rows binary, columns binary, weights binary, ids binary, sizes binary, signs binary, dense binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _dense_apart(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(rows, grams, weights of the dense columns, packed rows of the dense columns) of a block's entries, marks of dense columns last."""
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    del order
    # In sorted order a dense column is where a hash comes back DENSE - 1 places on.
    begins = np.flatnonzero(gram[: len(gram) - DENSE + 1] == gram[DENSE - 1 :]) if len(gram) >= DENSE else np.zeros(0, dtype=np.int64)
    if not len(begins):
        return row, gram, begins, np.zeros(1, dtype="<u4").tobytes()
    columns = np.unique(gram[begins])
    begins, ends = np.searchsorted(gram, columns), np.searchsorted(gram, columns, side="right")
    edge = np.zeros(len(gram) + 1, dtype=np.int8)
    edge[begins] += 1
    edge[ends] -= 1
    apart = np.cumsum(edge[:-1], dtype=np.int8) > 0
    packed = np.concatenate([[len(columns)], ends - begins, row[apart]]).astype("<u4").tobytes()
    marks = (MARK + np.arange(len(columns))).astype(np.uint32)
    return np.concatenate([row[~apart], marks]), np.concatenate([gram[~apart], columns]), ends - begins, packed


def _dense_rows(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the dense columns of a block, and their rows."""
    numbers = np.frombuffer(packed, dtype="<u4")
    n = int(numbers[0])
    return np.concatenate([[0], np.cumsum(numbers[1 : n + 1], dtype=np.int64)]), numbers[n + 1 :]


def _matrix(docs: DataFrame, buckets: int, n: int) -> DataFrame:
    """Packed blocks of the matrix. Of equal sets in a row block one is in it; a list of all its documents goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, ids, entries = [], [], 0

        def closed():
            row = np.concatenate([r + b for b, (r, _) in zip(np.cumsum([0, *[len(i) for i in ids[:-1]]]), held)]) if held else np.zeros(0, dtype=np.int64)
            gram = np.concatenate([g for _, g in held])
            held.clear()
            every = np.concatenate(ids)
            sizes = np.bincount(row, minlength=len(every))
            ends = np.cumsum(sizes)
            signs = []
            for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(gram + np.uint64(salt)), dtype=np.uint64)])
                signs.append(sums[ends] - sums[ends - sizes])
            signs = np.stack(signs, axis=1)
            _, firsts, which = np.unique(np.column_stack([signs, sizes.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
            stays = (firsts[which.ravel()] == np.arange(len(every)))[row]
            row, gram, weight, dense = _dense_apart(row[stays].astype(np.uint32), gram[stays])
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            column = gram // np.uint64(buckets) & LOW_40
            order = np.argsort(bucket, kind="stable")
            row, column = row[order], column[order]
            borders = np.searchsorted(bucket[order], np.arange(buckets + 1))
            del gram, bucket, order
            block = part << 24 | number
            empty = b""
            out = [(block, block % buckets, empty, empty, empty, every.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), signs.astype("<u8").tobytes(), dense)]
            for b in np.flatnonzero(np.diff(borders)).tolist():
                own = row[borders[b] : borders[b + 1]]
                weights = weight[own[own >= MARK] - MARK].astype("<u4").tobytes()
                out.append((block, b, own.astype("<u4").tobytes(), _five_bytes(column[borders[b] : borders[b + 1]]), weights, empty, empty, empty, empty))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), *[pa.binary()] * 7])], NAMES)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, rows, row, gram in shingle_sets(batch.column(1), n):
                held.append((row, gram))
                ids.append(keys[first : first + rows])
                entries += len(gram)
                if entries >= ROW_BLOCK:
                    yield closed()
                    number, held, ids, entries = number + 1, [], [], 0
        if ids:
            yield closed()

    return docs.mapInArrow(run, BLOCKS)


def _shared_columns(matrix: DataFrame) -> DataFrame:
    """By column block: the entries of columns with two or more, sent back to their row blocks with the column's number and count.

    A column that many documents share has one entry here for each row block, not for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, rows, columns, weights, bucket = [], [], [], [], 0
        for batch in batches:
            for record in batch.to_pylist():
                if record["ids"]:
                    yield pa.RecordBatch.from_pylist([{**record, "counts": b""}], schema=batch.schema.append(pa.field("counts", pa.binary())))
                if record["rows"]:
                    bucket = record["bucket"]
                    blocks.append(record["block"])
                    rows.append(np.frombuffer(record["rows"], dtype="<u4"))
                    columns.append(_from_five_bytes(record["columns"]))
                    weights.append(np.ones(len(rows[-1]), dtype=np.uint32))
                    weights[-1][rows[-1] >= MARK] = np.frombuffer(record["weights"], dtype="<u4")
        if not blocks:
            return
        source = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(r) for r in rows])
        row, column = np.concatenate(rows), np.concatenate(columns)
        rows.clear(), columns.clear()
        order = np.argsort(column, kind="stable")
        column = column[order]
        begins = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        count = np.repeat(np.add.reduceat(np.concatenate(weights)[order], begins, dtype=np.int64), np.diff(np.append(begins, len(column))))
        shared = count > 1
        order, column, count = order[shared], column[shared], count[shared]
        source, row = source[order], row[order]
        column = column | np.uint64(bucket << 40)
        order = np.argsort(source, kind="stable")
        borders = np.searchsorted(source[order], np.arange(len(blocks) + 1))
        for i, block in enumerate(blocks):
            at = order[borders[i] : borders[i + 1]]
            if len(at):
                counts = np.minimum(count[at], 0xFFFFFFFF).astype("<u4").tobytes()
                values = [block, bucket, row[at].astype("<u4").tobytes(), column[at].astype("<u8").tobytes(), b"", b"", b"", b"", b"", counts]
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 8]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [*NAMES, "counts"])

    return matrix.groupBy("bucket").applyInArrow(run, f"{BLOCKS}, counts binary")


def _rows(shared: DataFrame, percent: int) -> DataFrame:
    """By row block: (doc_id, n, s1, s2, columns), a row per document.

    ``columns`` holds the shared columns, rarest first, of documents that can have a partner; equal sets of a block have it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns, counts = [], [], []
        ids = sizes = signs = dense = None
        for batch in batches:
            for record in batch.to_pylist():
                if record["ids"]:
                    ids, sizes = np.frombuffer(record["ids"], dtype="<i8"), np.frombuffer(record["sizes"], dtype="<u4").astype(np.int64)
                    signs, dense = np.frombuffer(record["signs"], dtype="<u8").reshape(-1, 2), record["dense"]
                if record["rows"]:
                    rows.append(np.frombuffer(record["rows"], dtype="<u4"))
                    columns.append(np.frombuffer(record["columns"], dtype="<u8"))
                    counts.append(np.frombuffer(record["counts"], dtype="<u4"))
        packed: list[bytes | None] = [None] * len(ids)
        if rows:
            row, column, count = np.concatenate(rows), np.concatenate(columns), np.concatenate(counts)
            rows.clear(), columns.clear(), counts.clear()
            marked = row >= MARK
            if marked.any():
                borders, members = _dense_rows(dense)
                which = row[marked] - MARK
                times = borders[which + 1] - borders[which]
                at = np.repeat(borders[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                row, column, count = (np.concatenate([x[~marked], y]) for x, y in ((row, members[at]), (column, np.repeat(column[marked], times)), (count, np.repeat(count[marked], times))))
            order = np.lexsort((column, count, row))
            row, column = row[order], column[order]
            borders = np.searchsorted(row, np.arange(len(ids) + 1))
            known = np.diff(borders)
            for i in np.flatnonzero((known > 0) & (known >= least_overlap(sizes, percent))).tolist():
                packed[i] = column[borders[i] : borders[i + 1]].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(sizes), pa.array(signs[:, 0].view(np.int64)), pa.array(signs[:, 1].view(np.int64)), pa.array(packed, pa.binary())],
            ["doc_id", "n", "s1", "s2", "columns"],
        )

    return shared.groupBy("block").applyInArrow(run, "doc_id long, n long, s1 long, s2 long, columns binary")


def _first_columns(rows: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, place) of the columns among which any two linked rows share one; columns of one entry come first and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for i, packed in enumerate(batch.column("columns").to_pylist()):
                columns = np.frombuffer(packed, dtype="<u8")
                alone = int(sizes[i]) - len(columns)
                first = columns[: int(sizes[i]) - int(least_overlap(sizes[i], percent)) + 1 - alone]
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(np.full(k, batch.column("id")[i].as_py())), pa.array(np.full(k, sizes[i])), pa.array(alone + np.arange(k))],
                    ["token", "id", "n", "place"],
                )

    return rows.select("id", "n", "columns").mapInArrow(run, "token long, id long, n long, place long")


def _counted_pairs(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, counted over all their columns, links them."""
    left = rows.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("columns").alias("columns_a"))
    right = rows.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("columns").alias("columns_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            overlap = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8"), assume_unique=True))
                for x, y in zip(batch.column("columns_a"), batch.column("columns_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(linked(np.array(overlap, dtype=np.int64), total, percent)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "columns_a", "columns_b").mapInArrow(run, "a long, b long")


def _stretches(rows: list[np.ndarray]) -> list[tuple[int, int]]:
    """The rows in stretches of about ``PRODUCT_ENTRIES`` entries."""
    ends = np.cumsum([len(r) for r in rows]) // PRODUCT_ENTRIES
    borders = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(rows)]
    return list(zip(borders[:-1], borders[1:]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all rows of two chunks, a few hundred thousand entries of each at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for a, b in _stretches(left):
        for c, d in _stretches(right):
            out[a:b, c:d] = _product(left[a:b], right[c:d])
    return out


def _product(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Dense strips of the columns that both sides have, multiplied and summed up."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for side, values in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        has = common[at] == values if len(common) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[has], kind="stable")
        sides.append((row[has][order], at[has][order]))
    for start in range(0, len(common), width):
        strips = []
        for (row, at), n in zip(sides, (len(left), len(right))):
            lo, hi = np.searchsorted(at, [start, start + width])
            strip = np.zeros((n, width), dtype=np.float32)
            strip[row[lo:hi], at[lo:hi] - start] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T
    return out.astype(np.int64)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Few pairs that connect what the links of a chunk product connect: each row to its first partner, each column to its first."""
    out = set()
    for i in np.flatnonzero(links.any(axis=1)).tolist():
        out.add((int(left[i]), int(right[links[i].argmax()])))
    # Partners of one row are chained through that row only where their own first partner is another one.
    for j in np.flatnonzero(links.any(axis=0)).tolist():
        out.add((int(left[links[:, j].argmax()]), int(right[j])))
    parent = {x: x for pair in out for x in pair}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in out:
        parent[root(a)] = root(b)
    for i, j in np.argwhere(links).tolist():
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            out.add((int(left[i]), int(right[j])))
            parent[a] = b
    return sorted(out)


def _chunk_products(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b, links) from the rows of groups, multiplied chunk by chunk.

    ``links`` is 0 in pairs that connect, and the number of documents that a is linked to in rows where b is a.
    """
    # Sizes go to the members' few numbers, not to their columns: nothing long is dealt out by component.
    sizes = groups.join(rows.select("id", "n"), groups["node"] == rows["id"]).groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("entries"))
    chunks = F.greatest(F.ceil(F.col("members") / F.lit(CHUNK)), F.ceil(F.col("entries") / F.lit(CHUNK_ENTRIES))).cast("int")
    sized = written(groups.join(sizes, "component").select("node", "component", chunks.alias("chunks")), "sized-groups")
    member = rows.join(sized, rows["id"] == sized["node"])
    chunks = F.col("chunks")
    member = member.select("component", "id", "n", "copies", "columns", chunks.alias("chunks"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
    dealt = member.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "n", "copies", "columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [r for batch in batches for r in batch.to_pylist()]
        i, j = records[0]["i"], records[0]["j"]
        sides = [sorted((r for r in records if r["chunk"] == c), key=lambda r: r["id"]) for c in (i, j)]
        if not sides[0] or not sides[1]:
            return
        columns = [[np.frombuffer(r["columns"], dtype="<u8") for r in side] for side in sides]
        ids, n, copies = ([np.array([r[k] for r in side], dtype=np.int64) for side in sides] for k in ("id", "n", "copies"))
        links = linked(overlaps(*columns), n[0][:, None] + n[1][None, :], percent)
        if i == j:
            links &= ids[0][:, None] != ids[1][None, :]
        partners = list(zip(ids[0].tolist(), (links @ copies[1]).tolist()))
        if i != j:
            partners += list(zip(ids[1].tolist(), (links.T @ copies[0]).tolist()))
        found = [(a, b, 0) for a, b in forest(links, *ids)] + [(a, a, k) for a, k in partners if k]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "links"])

    return dealt.repartition("component", "i", "j").groupBy("component", "i", "j").applyInArrow(run, "a long, b long, links long")


def joined(docs: DataFrame, percent: int = PERCENT, n: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row per input row.

    Component: the smallest id reachable by links, the document's own included. n_links counts the documents with another or an equal
    text that it is linked to. Null and wordless texts have no n-grams and no links. Rows without an id are not compared and have a
    null component; rows that share an id are one node of the graph.
    """
    rows_in = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    known = rows_in.where("doc_id is not null")
    characters = known.agg(F.sum(F.length("text"))).head()[0] or 0
    buckets = max(1, -(-characters // (6 * COLUMN_BLOCK)))
    rows = written(_rows(_shared_columns(_matrix(known, buckets, n)), percent), "shared-columns")
    classes = written(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "equal-sets")
    distinct = rows.where("columns is not null").groupBy("s1", "s2", "n").agg(F.first("columns").alias("columns"))
    matrix = written(distinct.join(classes, ["s1", "s2", "n"]).select("id", "n", "copies", "columns"), "rows")
    first = written(_first_columns(matrix, percent), "first-columns")
    sizes = first.groupBy("token").agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("hub")).where("entries > 1")
    entries = first.join(sizes, "token")
    groups = written(components(entries.where(F.col("entries") > SPARSE_COLUMN).select(F.col("hub").alias("a"), F.col("id").alias("b"))), "groups")
    sparse = entries.where(F.col("entries") <= SPARSE_COLUMN)
    left = sparse.select("token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"))
    right = sparse.select("token", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
    # The first column that a pair shares leaves it so much overlap at most; sizes and places together discard the rest.
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = left.join(right, "token").where("a < b").where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
    own = groups.select(F.col("node").alias("a"), F.col("component").alias("group_a"))
    other = groups.select(F.col("node").alias("b"), F.col("component").alias("group_b"))
    pairs = pairs.join(own, "a", "left").join(other, "b", "left").where("group_a is null or group_b is null or group_a <> group_b").select("a", "b")
    copies = matrix.select("id", "copies")
    counted = written(_counted_pairs(pairs, matrix, percent), "counted-pairs")
    products = written(_chunk_products(matrix, groups, percent), "chunk-products")
    ends = counted.select("a", "b").union(counted.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = ends.join(copies, ends["b"] == copies["id"]).select(F.col("a"), F.col("copies").alias("links")).union(products.where("a = b").select("a", "links"))
    partners = partners.groupBy("a").agg(F.sum("links").alias("links"))
    found = components(counted.select("a", "b").union(products.where("a <> b").select("a", "b")))
    of_class = classes.join(found, classes["id"] == found["node"], "left").join(partners, classes["id"] == partners["a"], "left")
    of_class = of_class.select("s1", "s2", F.col("n").alias("size"), F.coalesce("component", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(of_class, (rows["s1"] == of_class["s1"]) & (rows["s2"] == of_class["s2"]) & (rows["n"] == of_class["size"]), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.union(_without_id(rows_in, n))


def _without_id(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for first, count, row, _ in shingle_sets(batch.column(0), n):
                sizes[first : first + count] = np.bincount(row, minlength=count)
            yield pa.RecordBatch.from_arrays([pa.array(sizes)], ["n_shingles"])

    sizes = rows.where("doc_id is null").select("text").mapInArrow(run, "n_shingles long")
    return sizes.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, joined_docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, and those without an id."""
    dropped = joined_docs.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(dropped, id_column, "left_anti").select(docs.columns)
