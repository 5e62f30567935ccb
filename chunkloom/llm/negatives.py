"""Hard negatives of anchor vectors by the threshold algorithm.

Rows are dealt into cells of at most about ``CELL_ROWS`` rows and ``CELL_ANCHORS`` anchors. A cell sorts its rows by each dimension. For an
anchor it goes down the lists of the dimensions, from the top where the anchor's component is positive and from the bottom where it is
negative, and scores each row that comes up for the first time by the whole integer inner product. A row not yet seen scores at most
the sum over the dimensions of the anchor's component times the list's value: once this threshold lies strictly below the k-th score of
each of the anchor's windows (or below the window itself), the cell is done with the anchor; ties with the k-th score are still seen.

Two passes: positives (rows of the anchor's label; cells of one label), then the windows around their scores (all cells). A label or a
vector that many rows share is many cells, as any other rows are. The best of each cell are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.session import written

#: Rows and anchors of a cell. A cell's rows are sent once for each ``CELL_ANCHORS`` anchors: larger executors should take larger cells.
CELL_ROWS, CELL_ANCHORS = 16_384, 16_384
POSITIVES, FIRST = 5, 10
#: Scores of negatives, in hundredths of the positive's score.
LEAST, MOST = 30, 90
#: Depth of the first step down the lists; it doubles from step to step.
FIRST_STEP = 16
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, label, v): components as floor(256 x), packed. Rows with a null id, label, vector or component, or one that is not finite, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = offsets - offsets[0]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = np.flatnonzero(bad[offsets[1:]] == bad[offsets[:-1]])
            # Beyond 2**40 sixty-four bits hold no inner product of common length; such vectors are refused when they are scored.
            y = np.clip(np.floor(256 * np.where(np.isfinite(x), x, 0)), -(1 << 41), 1 << 41).astype("<i8")
            packed = [y[offsets[i] : offsets[i + 1]].tobytes() for i in good]
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null").mapInArrow(run, "vec_id long, label long, v binary")


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(packed), width), dtype=np.int64)
    for i, p in enumerate(packed):
        out[i, : len(p) // 8] = np.frombuffer(p, dtype="<i8")
    return out


class Lists:
    """Rows of a cell with their places sorted along each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, largest: int):
        most = int(np.abs(rows).max(initial=0)) * largest * max(rows.shape[1], 1)
        if most >= 1 << 63:
            raise OverflowError("inner products beyond 64 bits")
        # Whole numbers below 2**53 stay exact as doubles, whose products are much faster.
        self.rows = rows.astype(np.float64) if most < EXACT else rows
        self.ids, self.labels = ids, labels
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.scored = 0

    def best(self, anchor: np.ndarray, id_: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window [low, high] the scores and ids of its first k rows."""
        n = len(self.ids)
        anchor = anchor.astype(self.rows.dtype)
        used = np.flatnonzero(anchor)
        if not len(used):  # all scores are 0: one list brings up all rows
            used = np.arange(min(1, len(anchor)))
        up = anchor[used] < 0
        seen = np.zeros(n, dtype=bool)
        scores, ids = np.zeros(0, dtype=self.rows.dtype), np.zeros(0, dtype=np.int64)
        fits = (self.labels == label) & (self.ids != id_) if same else self.labels != label
        depth, step, lowest = 0, FIRST_STEP, min((low for low, _ in windows), default=0)
        while depth < n:
            end = min(n, depth + step)
            if len(used):
                at = np.where(up[None, :], np.arange(depth, end)[:, None], np.arange(n - 1 - depth, n - 1 - end, -1)[:, None])
                came = self.order[at, used[None, :]].ravel()
                last = self.order[at[-1], used]
                threshold = (anchor[used] * self.rows[last, used]).sum()
            else:
                came, end, threshold = np.arange(n), n, 0
            new = np.zeros(n, dtype=bool)
            new[came] = True
            new &= ~seen
            seen |= new
            new = np.flatnonzero(new & fits)
            self.scored += len(new)
            found = self.rows[new] @ anchor
            take = found >= lowest
            scores, ids = np.concatenate([scores, found[take]]), np.concatenate([ids, self.ids[new[take]]])
            if all(threshold < low or self._full(scores, low, high, k, threshold) for low, high in windows):
                break
            depth, step = end, 2 * step
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            inside = inside[np.lexsort((ids[inside], -scores[inside]))[:k]]
            out.append((scores[inside].astype(np.int64), ids[inside]))
        return out

    @staticmethod
    def _full(scores: np.ndarray, low: int, high: int, k: int, threshold) -> bool:
        """Whether the window has k scores above the threshold."""
        return int(np.count_nonzero((scores >= low) & (scores <= high) & (scores > threshold))) >= k


ANYTHING = (-(1 << 63), (1 << 63) - 1)


def _parts(n, size: int):
    """Cells along one side for ``n`` rows (a column or a number)."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")


def _cells(rows: DataFrame, anchors: DataFrame, keys: list[str], same: bool, k: int, low: int, high: int) -> DataFrame:
    """(anchor, window, id, score) of the best of each cell. Both inputs have their numbers of cells in row_parts and anchor_parts."""
    cell = [*keys, "i", "j"]
    label = [c for c in ("label",) if c not in keys]
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("vec_id", "v"), F.col("row_parts")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("anchor_parts") - 1))).select(*cell, "vec_id", *label, "v")
    asking = anchors.withColumn("j", F.pmod(F.xxhash64("anchor"), F.col("anchor_parts")).cast("int"))
    asking = asking.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))
    asking = asking.select(*cell, "anchor", F.col("vec_id").alias("own"), *label, F.col("v").alias("w"), *([] if same else ["positives"]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            v, w = left.column("v").to_pylist(), right.column("w").to_pylist()
            width = max(len(p) for p in (*v, *w)) // 8
            asked = matrix(w, width)
            lists = Lists(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), matrix(v, width), int(np.abs(asked).max(initial=0)))
            about = zip(*(right.column(c).to_pylist() for c in ("anchor", "own", "label")), [[None]] * right.num_rows if same else right.column("positives").to_pylist())
            for vector, (anchor, own, label, positives) in zip(asked, about):
                windows = [ANYTHING if p is None else (-(-low * p // 100), high * p // 100) for p in positives]
                for number, (scores, ids) in enumerate(lists.best(vector, own, label, same, windows, k)):
                    out[0].append(np.full(len(ids), anchor))
                    out[1].append(np.full(len(ids), number))
                    out[2].append(ids)
                    out[3].append(scores)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["anchor", "window", "id", "score"])

    return dealt.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInArrow(run, "anchor long, window long, id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, k: int = FIRST, low: int = LEAST, high: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from :func:`quantised` rows and those of them that are anchors.

    Positives: the first rows of the anchor's label with another id, by score, then id. Negatives of a positive: the first ``k`` rows of other
    labels whose score lies between ``low`` and ``high`` hundredths of the positive's (none, if that is below 0). Repeated rows count each:
    a repeated anchor has its rows repeated, a repeated row takes a rank each time. Vectors of unlike length meet as if filled up with zeros.
    Tables without rows or anchors give no rows; inner products beyond 64 bits are refused.
    """
    anchors = written(anchors.select("vec_id", "label", "v").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    by_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(anchors.groupBy("label").agg(F.count(F.lit(1)).alias("asked")), "label")
    by_label = written(by_label.select("label", _parts(F.col("n"), CELL_ROWS).alias("row_parts"), _parts(F.col("asked"), CELL_ANCHORS).alias("anchor_parts")), "labels")
    first = _merged(_cells(rows.join(by_label, "label"), anchors.join(by_label, "label"), ["label"], True, positives, low, high), positives)
    first = written(first.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most as many as there are positives for an anchor, in their order.
    windows = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda s: s["positive_score"]).alias("positives"))
    asking = written(anchors.join(windows, "anchor"), "windows")
    n, asked = rows.count(), asking.count()
    both = [df.withColumns({"row_parts": _parts(F.lit(n), CELL_ROWS), "anchor_parts": _parts(F.lit(asked), CELL_ANCHORS)}) for df in (rows, asking)]
    found = _merged(_cells(*both, [], False, k, low, high), k)
    out = found.join(first, ["anchor", "window"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
