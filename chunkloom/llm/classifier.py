"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed indicators of byte 3-grams, words, word pairs and repeated words of the whole text. A feature's scale is the log ratio of its smoothed
share among good and bad documents; each scaled vector has length 1. The model is fitted by dual coordinate
descent on a bounded sample of labelled documents (``SAMPLE`` per class, drawn by a hash of the id); a fifth of the
sample is left out of it and fits the sigmoid that turns margins into scores. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import shingles, text_slices, word_hashes, words

SLOTS = 1 << 18
#: Labelled documents of each class that the model is fitted on, at most (on average; the draw is by hash).
SAMPLE = 4000
#: One fifth of all ids is held out of every fit.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # naive Bayes scale times linear weight, by slot
    scales: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        margins = np.empty(len(column))
        for i, slots in features(column):
            scale = self.scales[slots]
            length = math.sqrt(float(scale @ scale))
            margins[i] = (float(self.weights[slots].sum()) / length if length else 0.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -50, 50)))


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct slots) of each text; a null or empty text has none."""
    last = np.zeros(SLOTS, dtype=np.int64)
    third = np.uint64(SLOTS // 4)
    for first, data, offsets in text_slices(column):
        n = len(offsets) - 1
        starts, ends, owner = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        pairs, pair_owner = shingles(hashes, owner, 2)
        wide = data.astype(np.uint64)
        grams = (wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) if len(data) > 2 else np.zeros(0, dtype=np.uint64)
        grams = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % (np.uint64(2) * third)
        again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        thrice = again[1:] & again[:-1]
        doubled = np.bincount(owner[1:][again], minlength=n) > 0, np.bincount(owner[2:][thrice], minlength=n) > 0
        hashes, pairs = np.uint64(2) * third + hashes % third, np.uint64(3) * third + np.uint64(2) + pairs % (third - np.uint64(2))
        word_ends = np.searchsorted(owner, np.arange(n + 1))
        pair_ends = np.searchsorted(pair_owner, np.arange(n + 1))
        for i in range(n):
            slots = np.concatenate([
                grams[offsets[i] : max(offsets[i], offsets[i + 1] - 2)], hashes[word_ends[i] : word_ends[i + 1]], pairs[pair_ends[i] : pair_ends[i + 1]],
                np.flatnonzero([d[i] for d in doubled]).astype(np.uint64) + np.uint64(3) * third,  # a word twice, three times running
            ]).astype(np.int64)
            place = np.arange(len(slots))
            last[slots] = place  # of equal slots the last one stays
            yield first + i, slots[last[slots] == place]


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> tuple[list[tuple[int, int, np.ndarray]], dict[int, int]]:
    """(draw, label, slots) of the sampled documents, and how many there are of each label. Held-out ids and null labels are left out; labels without a document only count for the classes' shares.

    Ids with both labels are left out as well. The drawn ids are few by construction and are broadcast; the texts stay where they lie.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).where(~held_out(id_column))
    marked = marked.groupBy(F.col(id_column).alias("_id")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other and label in (0, 1)")
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(1_000_000_007))
    shares = [F.when(F.col("label") == k, F.lit(int(1_000_000_007 * min(1.0, sample / max(1, n))))) for k, n in sizes.items()]
    if not shares:
        return [], {}
    drawn = marked.select("_id", F.col("label").cast("int").alias("label"), draw.alias("draw")).where(F.col("draw") < F.coalesce(*shares))
    own = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(drawn), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, slots in features(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([np.sort(slots).astype("<i4").tobytes()], pa.binary())], ["draw", "label", "slots"])

    rows = own.select("draw", "label", "text").mapInArrow(run, "draw long, label int, slots binary").collect()
    found = {(r["draw"], r["label"], bytes(r["slots"])) for r in rows}  # repeated rows count once
    return [(d, y, np.frombuffer(s, dtype="<i4").astype(np.int64)) for d, y, s in sorted(found)], sizes


def naive_bayes_scales(rows: list[np.ndarray], signs: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = {s: np.full(SLOTS, smoothing) for s in (1, -1)}
    for slots, sign in zip(rows, signs):
        counts[int(sign)][slots] += 1
    seen = (counts[1] + counts[-1]) > 2 * smoothing
    ratio = np.log(counts[1] / (signs == 1).sum()) - np.log(counts[-1] / (signs == -1).sum())
    return np.where(seen, ratio, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * hinge loss; the bias is a feature of value 1."""
    weights, bias, alpha, order = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            slots, value, sign = rows[i], values[i], signs[i]
            gradient = sign * (float(weights[slots] @ value) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign
            if step:
                alpha[i] = new
                weights[slots] += step * value
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return weights, bias


def sigmoid(margins: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset by Newton's method on the log loss with softened targets and a slight pull to 0."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x, at = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -50, 50)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x @ (p - target) + 1e-6 * at)
        at = at - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(sample: list[tuple[int, int, np.ndarray]], sizes: dict[int, int]) -> Model:
    """The sample holds one class more often than the labels do; ``sizes`` puts the scores right again. Without both classes there is nothing to learn: every score is the share of good labels (0.5 without any)."""
    labels = np.array([y for _, y, _ in sample])
    zero = np.zeros(SLOTS, dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(zero, zero, 0.0, 1.0, math.log(share / (1 - share)))
    signs, apart = np.where(labels == 1, 1, -1), np.array([d % 5 == 0 for d, _, _ in sample])
    if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
        apart[:] = True  # too few to leave any out
        chosen = np.arange(len(sample))
    else:
        chosen = np.flatnonzero(~apart)
    rows = [sample[i][2] for i in chosen]
    scales = naive_bayes_scales(rows, signs[chosen])
    lengths = [max(1e-12, float(np.sqrt(scales[r] @ scales[r]))) for r in rows]
    values = [scales[r] / n for r, n in zip(rows, lengths)]
    share = (signs[chosen] == 1).mean()
    cost = np.where(signs[chosen] == 1, 0.5 / share, 0.5 / (1 - share))
    weights, bias = dual_coordinate_descent(rows, values, signs[chosen], cost, SLOTS)
    scaled = (weights * scales).astype(np.float32)
    left = np.flatnonzero(apart)
    margins = []
    for i in left:
        slots = sample[i][2]
        length = float(np.sqrt(scales[slots] @ scales[slots]))
        margins.append((float(scaled[slots].sum()) / length if length else 0.0) + bias)
    slope, offset = sigmoid(np.array(margins), labels[left] == 1)
    offset += math.log(sizes[1] / sizes[0]) - math.log((labels == 1).sum() / (labels == 0).sum())
    return Model(scaled, scales.astype(np.float32), bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    return fit(*training_sample(docs, labels, **columns))


def _sent(docs: DataFrame, model: Model):
    """The model's fields for the workers: 2 MB, whatever the corpus. A broadcast class would have to be installed there."""
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.scales, model.bias, model.slope, model.offset))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per input row; null counts as an empty text.

    Rows that repeat get the same score each, rows without an id are scored too (``held_out`` is null), an empty table gives no rows, and
    columns beside the two named are not looked at.
    """
    spread = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = Model(*spread.value).scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def kept_documents(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with its own columns."""
    spread, text = _sent(docs, model), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(Model(*spread.value).scores(batch.column(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
