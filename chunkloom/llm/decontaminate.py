"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the normalised benchmark items reads each text once.

A text is normalised to its words (letters, digits and characters beyond ASCII, A-Z lowered) with one space around each, so that a window
of an item can only be found where words begin and end. Places in the normalised text lead back to words, and words to characters of
the original.

The windows go to the workers in parts of at most ``PART_BYTES``, measured first; usually there is one part, and then nothing is shuffled.
With more, each part reads the texts once more and hands on only the texts in which it found something.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from chunkloom.llm.common import TERM_BYTES, fresh, in_worker, terms
from chunkloom.session import written

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of windows and item ids in one automaton; it takes some 50 times as much in a worker's memory.
PART_BYTES = 4_000_000
#: Characters handed to the automaton at a time.
STEP_CHARS = 1 << 20

SPANS = "array<struct<start:long,end:long,first_word:long,end_word:long>>"
SPAN_KIND = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first_word", "end_word")]))


def windows(benchmark: DataFrame, width: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, words, pattern): each window of each item once, its words joined by spaces. Items without id or words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                said = terms(text)
                made = {b" ".join(said[i : i + width]) for i in range(max(1, len(said) - width + 1))} if said else ()
                if made:
                    sizes = pa.array([m.count(b" ") + 1 for m in made], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(made), pa.string()), sizes, pa.array(list(made), pa.binary())], ["item", "words", "pattern"])

    rows = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return rows.where("item is not null").mapInArrow(run, "item string, words int, pattern binary").distinct()


class Automaton:
    """The windows of one part; finds the word intervals and the items of a text."""

    def __init__(self, pairs: Iterable[tuple[str, int, bytes]]):
        import ahocorasick

        self.trie, self.words, self.items = ahocorasick.Automaton(), [], []
        numbers: dict[bytes, int] = {}
        for item, words, pattern in pairs:
            at = numbers.setdefault(bytes(pattern), len(numbers))
            if at == len(self.words):
                self.words.append(words)
                self.items.append([])
                self.trie.add_word(f" {bytes(pattern).decode('latin-1')} ", at)
            self.items[at].append(item)
        if numbers:
            self.trie.make_automaton()

    def found(self, said: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of words [first, end), apart and in order, and the items of the windows."""
        if not said or not self.words:
            return [], set()
        text = f" {b' '.join(said).decode('latin-1')} "
        ends, numbers = [], []
        scan = self.trie.iter(text[:STEP_CHARS])
        for start in range(STEP_CHARS, len(text) + STEP_CHARS, STEP_CHARS):
            for end, number in scan:
                ends.append(end)
                numbers.append(number)
            if start < len(text):
                scan.set(text[start : start + STEP_CHARS])
        if not ends:
            return [], set()
        spaces = np.cumsum([len(w) + 1 for w in said])
        last = np.searchsorted(spaces, ends)
        first = last + 1 - np.array([self.words[n] for n in numbers])
        return merged(zip(first.tolist(), (last + 1).tolist())), {i for n in set(numbers) for i in self.items[n]}


def merged(stretches: Iterable[tuple]) -> list[tuple]:
    """Stretches (start, end, ...) that overlap or touch as one; further pairs of numbers go along with start and end."""
    out: list[tuple] = []
    for s in sorted(stretches):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = tuple(old if i % 2 == 0 else new for i, (old, new) in enumerate(zip(out[-1], s)))
        else:
            out.append(s)
    return out


def character_spans(text: bytes, stretches: list[tuple[int, int]]) -> list[dict]:
    """Where stretches of words lie in the original, in characters."""
    black = np.frombuffer(text.translate(TERM_BYTES), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], black, [False]])))
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [
        {"start": int(before[edges[2 * a]]), "end": int(before[edges[2 * b - 1]]), "first_word": a, "end_word": b} for a, b in stretches
    ]


def _together(parts: list[DataFrame]) -> DataFrame:
    """(place, spans, items) of all parts, overlapping spans joined. A text has a row for each part at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("first_word", "end_word", "start", "end")
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                one = merged(tuple(s[n] for n in names) for spans in row["spans"] for s in spans)
                out.append({"place": row["place"], "spans": [dict(zip(names, s)) for s in one], "items": sorted({i for items in row["items"] for i in items})})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("place", pa.int64()), ("spans", SPAN_KIND), ("items", pa.list_(pa.string()))]))

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = rows.groupBy("place").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return rows.mapInArrow(run, f"place long, spans {SPANS}, items array<string>")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", part_bytes: int | None = None,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (ids of items with a window in the text, sorted as strings), spans and contaminated.

    ``spans`` are the hit passages: characters [start, end) of the text and words [first_word, end_word). A new column whose name the
    input has already takes an underscore in front. Null and wordless texts have no words and are clean; each row, also a repeated one or
    one without an id, is judged by itself. Items without an id or without words have no windows; rows that share an item id are one item.
    An empty benchmark leaves all documents clean, empty documents give no rows.
    """
    pairs = written(windows(benchmark, width, item_column, item_text_column), "benchmark-windows")
    size = pairs.agg(F.sum(F.octet_length("pattern") + F.octet_length("item"))).head()[0] or 0
    parts = max(1, -(-size // (part_bytes or PART_BYTES)))
    names = {n: fresh(docs.columns, n) for n in ("place", "n_words", "n_hit", "n_items", "items", "spans", "contaminated")}
    if parts == 1:
        out = _beside(docs, text_column, [tuple(r) for r in pairs.collect()], names)
    else:
        # Places must not change between the parts: the documents are written once with them.
        whole = written(docs.withColumn(names["place"], F.monotonically_increasing_id()), "numbered-documents", compression="zstd")
        text = whole.select(names["place"], text_column)
        found = []
        for part in range(parts):
            mine = pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(parts)) == part).collect()
            rows = _beside(text, text_column, [tuple(r) for r in mine], names).drop(text_column)
            found.append(written(rows if part == 0 else rows.where(F.size(names["spans"]) > 0), f"found-{part}"))
        counts = found[0].select(F.col(names["place"]).alias("_p"), names["n_words"])
        hits = _together([f.where(F.size(names["spans"]) > 0).select(F.col(names["place"]).alias("place"), F.col(names["spans"]).alias("spans"), F.col(names["items"]).alias("items")) for f in found])
        hits = hits.select(F.col("place").alias("_q"), F.col("spans").alias(names["spans"]), F.col("items").alias(names["items"]))
        out = whole.join(counts, whole[names["place"]] == counts["_p"]).join(hits, whole[names["place"]] == hits["_q"], "left")
        for n, kind in (("spans", SPANS), ("items", "array<string>")):
            out = out.withColumn(names[n], F.coalesce(F.col(names[n]), F.expr(f"cast(array() as {kind})")))
    hit = F.aggregate(names["spans"], F.lit(0).cast("long"), lambda total, s: total + s["end_word"] - s["first_word"])
    out = out.withColumn(names["n_hit"], hit).withColumn(names["n_items"], F.size(names["items"]).cast("long"))
    out = out.withColumn(names["contaminated"], F.col(names["n_hit"]) > 0)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[names[n] for n in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")])


def _beside(docs: DataFrame, text_column: str, pairs: list[tuple[str, int, bytes]], names: dict[str, str]) -> DataFrame:
    """What one part of the windows finds, as further columns of the documents, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    key = ("automaton", hashlib.sha256(repr(sorted(pairs)).encode()).hexdigest())
    at = docs.columns.index(text_column)
    kinds = [pa.int64(), pa.list_(pa.string()), SPAN_KIND]
    added = [names["n_words"], names["items"], names["spans"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = in_worker(key, lambda: Automaton(shared.value))
        for batch in batches:
            counts, items, spans = [], [], []
            for text in batch.column(at).cast(pa.string()).cast(pa.binary()):
                text = text.as_py()
                said = terms(text)
                stretches, ids = automaton.found(said)
                counts.append(len(said))
                items.append(sorted(ids))
                spans.append(character_spans(text, stretches) if stretches else [])
            made = [pa.array(values, kind) for values, kind in zip((counts, items, spans), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *added])

    fields = [StructField(name, DataType.fromDDL(kind)) for name, kind in zip(added, ("bigint", "array<string>", SPANS))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def without_passages(docs: DataFrame, found: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents of :func:`decontaminated` (``found``) with their hit passages cut out of the text."""
    kept = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda done, s: F.struct(
            s["end"].alias("at"),
            F.concat(done["text"], F.substring(F.col(text_column), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))).alias("text"),
        ),
    )
    rest = F.concat(kept["text"], F.substring(F.col(text_column), (kept["at"] + 1).cast("int"), F.length(text_column)))
    return found.withColumn(text_column, F.when(F.col("contaminated"), rest).otherwise(F.col(text_column))).select(docs.columns)
