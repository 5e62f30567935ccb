"""Byte-level BPE from a rank file: a rank queue in a hierarchical bitmap picks the merges.

Each merge rank has a bucket of places (first bytes of the left parts). A bitmap of three levels of 64-bit words says
which buckets hold something, so the smallest rank is found with three find-first-set steps, however long the pre-token is.
Parts form a linked list. An entry whose pair has changed meanwhile is stale and skipped when it comes up.
The smallest rank goes first, and of equal ranks the leftmost. Many short pre-tokens lie in one list with stops between them, so that
one step through the bitmap serves them all.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import in_worker
from chunkloom.llm.tokens import Encoder


class RankQueue:
    """Places by rank. Taking them all leaves it empty, so one queue serves all pre-tokens of a worker."""

    def __init__(self, n_ranks: int):
        words = (n_ranks >> 6) + 1
        self.low, self.middle, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, places: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = places
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.middle[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        else:
            bucket += places

    def first(self) -> int:
        """The smallest rank that has places; -1 if there is none."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """All places of a rank, from the left."""
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.top &= ~(1 << (word >> 6))
        places = self.buckets.pop(rank)
        places.sort()
        return places


#: Bytes of pre-tokens in one linked list; a longer pre-token has one of its own.
LIST_BYTES = 100_000


class BytePairs:
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.ranks, self.queue = ranks, RankQueue(max(ranks.values()) + 1)
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.encode_all([word])[0]

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int] | None] = []
        waiting, size = [], 0
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            out.append([whole] if whole is not None else [])
            if whole is None and word:
                if waiting and size + len(word) > LIST_BYTES:
                    self._merge(words, waiting, out)
                    waiting, size = [], 0
                waiting.append(i)
                size += len(word)
        if waiting:
            self._merge(words, waiting, out)
        return out

    def _merge(self, words: list[bytes], numbers: list[int], out: list) -> None:
        data = b"".join([words[i] for i in numbers])
        ends = list(accumulate(len(words[i]) for i in numbers))
        n = ends[-1]
        stop = bytearray(n + 1)  # where no part of the same pre-token begins
        for e in ends:
            stop[e] = 1
        letters = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        part = self.single[letters].tolist()  # the token that begins at a place
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where a part ends, where the one before begins
        before[0] = -1
        for e in ends[:-1]:
            before[e] = -1
        pairs = np.full(n, -1)
        pairs[:-1] = self.double[letters[:-1] << 8 | letters[1:]]
        pairs[np.array(ends) - 1] = -1
        queue, get = self.queue, self.ranks.get
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0) :]
        for places in np.split(order, np.flatnonzero(np.diff(pairs[order])) + 1) if len(order) else ():
            queue.add(int(pairs[places[0]]), places.tolist())
        waiting = pairs.tolist()  # the rank under which a place waits for its merge with the next part
        while (rank := queue.first()) >= 0:
            places = queue.take(rank)
            for at, i in enumerate(places):
                if waiting[i] != rank:
                    continue
                j = end[i]
                k = end[i] = end[j]
                part[i], waiting[j], lower = rank, -1, False
                found = -1
                if not stop[k]:
                    before[k] = i
                    found = get(data[i : end[k]], -1)
                    if found >= 0:
                        queue.add(found, [i])
                        lower = found <= rank
                waiting[i] = found
                if (h := before[i]) >= 0:
                    found = get(data[h:k], -1)
                    if waiting[h] != found:
                        waiting[h] = found
                        if found >= 0:
                            queue.add(found, [h])
                            lower = lower or found <= rank
                if lower:  # what is new goes first
                    if at + 1 < len(places):
                        queue.add(rank, places[at + 1 :])
                    break
        start = 0
        for number, e in zip(numbers, ends):
            ids = out[number]
            while start < e:
                ids.append(part[start])
                start = end[start]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def rank_file(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_pairs(path: str) -> BytePairs:
    return in_worker(("ranks", path), lambda: BytePairs(rank_file(path)))


def encoder(path: str, pattern: str) -> Encoder:
    """Texts cut by ``pattern``, each match by the queue; matches that a worker knows are looked up."""

    def build():
        import regex

        pairs = byte_pairs(path)
        return Encoder(lambda words: [array("I", ids).tobytes() for ids in pairs.encode_all([w.encode() for w in words])], regex.compile(pattern).findall)

    return in_worker(("byte pairs", path, pattern), build)


def encoded(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): packed 32-bit ids of every whole text; null counts as empty and has none.

    Rows that repeat, or have no id, are encoded one by one; an empty table gives no rows, and columns beside the two named are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                ids = list(own.encode([t or "" for t in rows.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (doc_id, n_tokens, ids) with the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                texts = []
                for packed in rows.column("ids").to_pylist():
                    ids = array("I")
                    ids.frombytes(packed or b"")
                    texts.append(own.decode(ids))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_tokens"), rows.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
