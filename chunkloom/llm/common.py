"""What several operators of this folder share: column checks, Arrow text buffers, word hashes, state kept by a worker."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one numpy step handles.
SLICE_BYTES = 1 << 19
#: Texts that are copied out of an Arrow batch at a time.
SLICE_ROWS = 1000
#: An odd multiplier that tells places apart in hashes.
PLACE = np.uint64(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A-Z lowered; bytes of ASCII that are no letter or digit become a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_worker(key, build):
    """What ``build`` makes, kept as long as the Python worker lives. Functions travel by value, so a module's globals do not last."""
    kept = sys.__dict__.setdefault("_chunkloom_kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def give_back() -> None:
    """Hand memory that this worker has freed back to the system; the allocators would keep much of an earlier stage's arrays beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front while a column of the input has it (case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_running_base(pieces: DataFrame, part: str, total: str, out: str) -> DataFrame:
    """For each ``part`` the sum of ``total`` over all smaller parts.

    One row per part (a file split or a shuffle partition) is all that the window sees: 16 bytes
    for each 100 MB or so of input.
    """
    sums = pieces.groupBy(part).agg(F.sum(total).alias("_sum"))
    return sums.select(
        part, F.coalesce(F.expr(f"sum(_sum) over (order by {part} rows between unbounded preceding and 1 preceding)"), F.lit(0)).cast("long").alias(out)
    )


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about ``SLICE_BYTES``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for begin in range(0, len(column), SLICE_ROWS):
        part = pc.fill_null(column.slice(begin, SLICE_ROWS).cast(pa.large_string()), "")
        _, raw, data = part.buffers()
        offsets = np.frombuffer(raw, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        start = 0
        while start < len(part):
            end = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
            end = min(max(end, start + 1), len(part))
            yield begin + start, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def terms(text: bytes | None) -> list[bytes]:
    """The runs of ASCII letters, digits and bytes beyond ASCII, A-Z lowered; of null there are none."""
    return text.translate(TERM_BYTES).split() if text else []


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (splitmix64's last steps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the text each lies in; no run crosses two texts."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    black = ~WHITE[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = black[inner]
    last[inner - 1] = black[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word (one byte at least): the sum over its stretches of eight bytes, each mixed with its place first.

    A plain polynomial modulo 2**64 over the bytes would give words built like a Thue-Morse sequence the same hash.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    count = (size + 7) >> 3
    begins = np.cumsum(count) - count
    place = np.arange(begins[-1] + count[-1]) - np.repeat(begins, count)
    rest = np.minimum(np.repeat(size, count) - 8 * place, 8).astype(np.uint64)
    letters = eight[np.repeat(starts, count) + 8 * place].astype(np.uint64) & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (rest << np.uint64(3))))
    mixed = mix(mix(letters + np.uint64(1)) + place.astype(np.uint64) * PLACE)
    return mix(np.add.reduceat(mixed, begins) + size.astype(np.uint64) * PLACE)


def shingles(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``n`` neighbouring words inside one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(m, dtype=np.uint64)
    for j, factor in enumerate(powers(0xD6E8FEB86659FD93, n + 1)[1:]):
        total += hashes[j : j + m] * factor
    inside = owner[:m] == owner[n - 1 :]
    return mix(total[inside]), owner[:m][inside]
