"""SimHash: signed votes of weighted term hashes, and block tables with flipped bits that find near fingerprints.

Terms are pairs of neighbouring words (a single word stands for itself), weighted by 1 + ln(count). Each of 128 bits is the sign of
the sum of weights, plus where the term's hash has the bit, minus where it has not. Weights are whole
numbers, so sums do not depend on their order.

Of fingerprints within a Hamming radius r, cut into r // 3 + 1 blocks, one block differs in two bits at most: both fingerprints
reach a common key by at most one flipped bit each. There is a table for each block. It is dealt by the first bits of the keys, so that only
flips among those send a fingerprint to further groups; the other flips are made inside the task. A pair is
taken once, at the first of its blocks that is near enough and the smallest of its common keys. A group with many fingerprints is
met chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import mix, shingles, text_slices, word_hashes, words

BITS = 128
#: Finds 92 of 100 copies with three changed words in 200 (README); texts that share nothing lie about 64 apart.
RADIUS = 14
#: Different fingerprints of a group that one task meets with each other; larger groups are cut into chunks.
FULL_BUCKET = 50_000
#: Fingerprints packed into rows at a time, and those in a row at most.
PACKED, PIECE = 100_000, 4096


def fingerprints(column: pa.Array) -> np.ndarray:
    """(texts, 2) 64-bit halves. Null and texts without words have no votes: all bits are 0."""
    out = np.zeros((len(column), 2), dtype=np.uint64)
    for first, data, offsets in text_slices(column):
        n = len(offsets) - 1
        starts, ends, owner = words(data, offsets)
        if not len(starts):
            continue
        hashes = word_hashes(data, starts, ends)
        pairs, pair_owner = shingles(hashes, owner, 2)
        alone = np.bincount(owner, minlength=n)[owner] == 1
        terms, term_owner = np.concatenate([pairs, hashes[alone]]), np.concatenate([pair_owner, owner[alone]])
        order = np.lexsort((terms, term_owner))
        terms, term_owner = terms[order], term_owner[order]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (term_owner[1:] != term_owner[:-1])
        at = np.flatnonzero(new)
        weights = np.rint(64 * (1 + np.log(np.diff(np.append(at, len(terms)))))).astype(np.float64)
        halves = np.stack([mix(terms[at]), mix(terms[at] + np.uint64(0x632BE59BD9B4E019))], axis=1)
        borders = np.searchsorted(term_owner[at], np.arange(n + 1))
        for i in range(n):
            a, b = borders[i], borders[i + 1]
            votes = np.zeros(BITS)
            for c in range(a, b, 4096):
                d = min(b, c + 4096)
                bits = np.unpackbits(halves[c:d].view(np.uint8).reshape(d - c, 16), axis=1)
                votes += weights[c:d] @ bits
            if b > a:
                out[first + i] = np.packbits(2 * votes > weights[a:b].sum()).view(np.uint64)
    return out


def hexed(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of unlike bits stands for; 0 from half of the bits on."""
    return np.where(distance(a, b) == 0, 1.0, np.maximum(0.0, np.cos(math.pi * distance(a, b) / BITS)))


def with_next(docs: DataFrame, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, text, stretch, extra) dealt so that within a stretch each text is followed by the next one by id.

    Stretches are ranges of the id, bounded by approximate quantiles of ids alone. Texts are shuffled once; the first row of each
    stretch goes to the stretch before as well (``extra``), that of the first stretch to the last. Null ids
    come first; rows that share an id follow their texts.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_column).cast("long"), F.lit(low)).alias("key"))
    shares = [i / partitions for i in range(1, partitions)] or [0.5]
    found = rows.agg(F.percentile_approx("key", shares, 100 * partitions)).head()[0] or []
    bounds = np.unique(np.array(found, dtype=np.int64))

    @F.pandas_udf("int")
    def stretch(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    firsts = rows.select(stretch("key").alias("stretch"), "key").groupBy("stretch").agg(F.min("key").alias("key")).orderBy("stretch").collect()  # one row per partition
    if not firsts:
        return rows.select("doc_id", "text", F.lit(0).alias("stretch"), "key", F.lit(0).alias("extra"))
    before = {r["key"]: firsts[i - 1]["stretch"] for i, r in enumerate(firsts)}
    keys = np.array(sorted(before), dtype=np.int64)
    goes = np.array([before[k] for k in keys.tolist()], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def stretches(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), side="right")
        at = np.minimum(np.searchsorted(keys, key.to_numpy()), len(keys) - 1)
        also = keys[at] == key.to_numpy()
        return pd.Series([[o, g] if a else [o] for o, g, a in zip(own.tolist(), goes[at].tolist(), also.tolist())])

    dealt = rows.select("doc_id", "text", "key", F.posexplode(stretches("key")).alias("extra", "stretch"))
    return dealt.repartition(partitions, "stretch").sortWithinPartitions("stretch", "extra", "key", "text")


def edited(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its last quarter (rounded down) replaced by as many first characters of the one that follows."""
    out = []
    for text, other in zip(texts, following):
        cut = len(text) // 4
        out.append(text[: len(text) - cut] + other[:cut])
    return out


def compared(docs: DataFrame, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per input row.

    Null texts count as empty; of a single document the next one is itself.
    """
    import hashlib

    def measure(ids, texts, following):
        other = edited(texts, following)
        own, changed, after = (fingerprints(pa.array(t, pa.large_string())) for t in (texts, other, following[-1:]))
        # A text's successor is the next row, but for the last one.
        after = np.concatenate([own[1:], after]) if len(own) else own
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other]),
                pa.array(hexed(own)), pa.array(hexed(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, here, closed = [], [], 0, None, False
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                for doc_id, text, stretch, extra in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "stretch", "extra"))):
                    if stretch != here:
                        here, closed = stretch, False
                        ids, texts, held = [], [], 0
                    if closed:
                        continue  # more rows that share the first id
                    if texts and (extra or held > 2_000_000):
                        yield measure(ids, texts, [*texts[1:], text])
                        ids, texts, held = [], [], 0
                    if extra:
                        closed = True
                    else:
                        ids.append(doc_id)
                        texts.append(text)
                        held += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, partitions, id_column, text_column).select("doc_id", "text", "stretch", "extra").mapInArrow(run, schema)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first, past last) bit of each block; each is a 64-bit number at most."""
    n = max(2, radius // 3 + 1)
    return [(BITS * i // n, BITS * (i + 1) // n) for i in range(n)]


def _values(prints: np.ndarray, blocks: list[tuple[int, int]]) -> list[np.ndarray]:
    """The number that each block's bits stand for; ``prints`` are (n, 2) 64-bit halves."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    out = []
    for a, b in blocks:
        value = np.zeros(len(bits), dtype=np.uint64)
        for k in range(a, b):
            value = value << np.uint64(1) | bits[:, k]
        out.append(value)
    return out


def _first_bits(n: int, blocks: list[tuple[int, int]]) -> int:
    """So many first bits of a key that an even spread leaves groups of half a full bucket at most."""
    p = 1
    while p < min(16, *(b - a for a, b in blocks)) and 2 * n * (p + 1) > FULL_BUCKET << p:
        p += 1
    return p


def _dealt(prints: DataFrame, blocks: list[tuple[int, int]], p: int) -> DataFrame:
    """(group, prints, copies, entries): packed fingerprints of each group of keys, by block and first p bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, copies, n = [], [], 0

        def packed():
            every, times = np.concatenate(held), np.concatenate(copies)
            groups, at = [], []
            for i, (value, (a, b)) in enumerate(zip(_values(every, blocks), blocks)):
                first = (value >> np.uint64(b - a - p)).astype(np.int64)
                for flip in (0, *(1 << k for k in range(p))):
                    groups.append(i << p | (first ^ flip))
                    at.append(np.arange(len(every)))
            group, at = np.concatenate(groups), np.concatenate(at)
            order = np.argsort(group, kind="stable")
            group, at = group[order], at[order]
            borders = [*np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist(), len(group)]
            out = []
            for begin, end in zip(borders[:-1], borders[1:]):
                for c in range(begin, end, PIECE):
                    rows = at[c : min(end, c + PIECE)]
                    out.append((int(group[begin]), every[rows].tobytes(), times[rows].tobytes(), len(rows)))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            for c in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[c : c + 1000]), kinds)], ["group", "prints", "copies", "entries"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64).reshape(-1, 2))
            copies.append(batch.column(1).to_numpy().astype("<i8"))
            n += batch.num_rows
            if n >= PACKED:
                yield from packed()
                held, copies, n = [], [], 0
        if held:
            yield from packed()

    return prints.select(F.unhex("fingerprint"), "copies").mapInArrow(run, "group long, prints binary, copies binary, entries long")


def _met(group: int, prints: np.ndarray, side: np.ndarray, blocks: list[tuple[int, int]], p: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) in stretches, of the pairs within ``radius`` that this group of keys has to give; of two sides only pairs across."""
    i, head = group >> p, np.uint64(group & (1 << p) - 1)
    values = _values(prints, blocks)
    value, low = values[i], np.uint64(blocks[i][1] - blocks[i][0] - p)
    own = np.flatnonzero(value >> low == head)
    other = np.flatnonzero(value >> low != head)
    keys = [value[own], *(value[own] ^ np.uint64(1 << k) for k in range(int(low))), head << low | value[other] & np.uint64((1 << int(low)) - 1)]
    key, at = np.concatenate(keys), np.concatenate([*[own] * (1 + int(low)), other])
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    across = side.any() and not side.all()
    here, step = np.arange(len(key)), 0
    while True:
        # Entries that have another one so many steps on under the same key.
        step += 1
        here = here[here + step < len(key)]
        here = here[key[here] == key[here + step]]
        if not len(here):
            return
        a, b = at[here], at[here + step]
        far = distance(prints[a], prints[b])
        near = far <= radius
        if across:
            near &= side[a] != side[b]
        a, b, far, at_key = a[near], b[near], far[near], key[here][near]
        x, y = value[a], value[b]
        unlike = x ^ y
        flip = np.where(np.bitwise_count(unlike) == 2, unlike & (~unlike + np.uint64(1)), np.uint64(0))
        once = np.minimum(x ^ flip, y ^ flip) == at_key
        for earlier in values[:i]:
            once &= np.bitwise_count(earlier[a] ^ earlier[b]) > 2
        if once.any():
            yield a[once], b[once], far[once]


def _tables(prints: DataFrame, radius: int, give, schema: str) -> DataFrame:
    """``give(prints, copies, stretches of pairs)`` for each group of keys; ``prints`` has fingerprint and copies, each fingerprint once."""
    if not 0 <= radius < BITS // 4:
        raise ValueError("the radius must leave each block four bits at least")
    blocks = _blocks(radius)
    p = _first_bits(prints.count(), blocks)
    # In order, so that a task that runs again packs the same rows.
    pieces = _dealt(prints.sortWithinPartitions("fingerprint"), blocks, p)
    full = pieces.groupBy("group").agg(F.sum("entries").alias("n")).where(F.col("n") > FULL_BUCKET)
    full = full.select("group", F.ceil(F.col("n") / F.lit(FULL_BUCKET)).cast("int").alias("chunks"))
    placed = pieces.join(F.broadcast(full), "group", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("prints"), F.col("chunks")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    placed = placed.select("group", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "prints", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [r for batch in batches for r in batch.to_pylist()]
        first = records[0]
        halves = [np.frombuffer(r["prints"], dtype=np.uint64).reshape(-1, 2) for r in records]
        side = np.repeat([r["chunk"] == first["j"] for r in records], [len(h) for h in halves])
        if first["i"] < first["j"] and (side.all() or not side.any()):
            return
        halves = np.concatenate(halves)
        copies = np.concatenate([np.frombuffer(r["copies"], dtype="<i8") for r in records])
        yield from give(halves, copies, _met(first["group"], halves, side, blocks, p, radius))

    return placed.groupBy("group", "i", "j").applyInArrow(run, schema)


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of all pairs a < b of different fingerprints within ``radius``; ``prints`` has the column fingerprint.

    Equal fingerprints count once. Each pair is given once.
    """

    def give(halves, copies, stretches):
        for a, b, far in stretches:
            ends = [sorted(pair) for pair in zip(hexed(halves[a]), hexed(halves[b]))]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends]), pa.array([e[1] for e in ends]), pa.array(far, pa.int32())], ["a", "b", "distance"])

    one = prints.select("fingerprint").where("fingerprint is not null").distinct().withColumn("copies", F.lit(1).cast("long"))
    return _tables(one, radius, give, "a string, b string, distance int")


def with_near_counts(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (with doc_id and fingerprint) and n_near: how many other rows have a fingerprint within ``radius``.

    Pairs are counted where they are found and never become rows.
    """

    def give(halves, copies, stretches):
        others = np.zeros(len(halves), dtype=np.int64)
        for a, b, _ in stretches:
            np.add.at(others, a, copies[b])
            np.add.at(others, b, copies[a])
        has = np.flatnonzero(others)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(hexed(halves[has])), pa.array(others[has])], ["a", "others"])

    sizes = rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    others = _tables(sizes, radius, give, "a string, others long").groupBy("a").agg(F.sum("others").alias("others"))
    counts = sizes.join(others, sizes["fingerprint"] == others["a"], "left").select("fingerprint", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
    return rows.join(counts, "fingerprint")
