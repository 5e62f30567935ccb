"""Quality rules whose cutoffs are risk-controlled.

Each rule rejects a document whose rate (symbols, repeated lines, ...) lies above a cutoff. The cutoff of each rule in each stratum
is chosen on labelled documents, so that with probability 1 - ``miss`` over all strata and rules together
the rules reject at most a share ``risk`` of the good documents of any stratum: the cutoffs of a rule are tried from the laxest
on, each by an exact binomial test at level miss / (strata * rules), until one fails (fixed sequence, so that trying many
costs nothing); ``risk`` is shared evenly by the rules. Of the cutoffs that passed, the one is taken that
tells bad from good best on the labelled documents. A rule without a passing cutoff is off. Strata with too few good documents
for any cutoff to pass are taken together as one stratum, for which the bound then holds as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import WHITE, mix, powers, text_slices, word_hashes, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
RISK, MISS = 0.05, 0.05
#: The stratum of all strata with few labels.
REST = "(rest)"
#: Cutoffs that are tried: rates, from lax to strict.
GRID = [1 - i / 200 for i in range(200)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_letters")
RULES = ("symbols", "dup_lines", "repeat_words", "upper", "marks")

SYMBOL, MARK, UPPER, LETTER = (np.zeros(256, dtype=bool) for _ in range(4))
SYMBOL[list(b"#*$%&|<>")] = True
MARK[list(b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")] = True
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[192:256] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that occur more than once, and of those that are not the first of their kind in sort order."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, any_of = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    again[order[1:]] = same
    any_of[order[1:]] |= same
    any_of[order[:-1]] |= same
    return any_of, again


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text. Equal lines and windows are told by 64-bit hashes inside a stretch of about 1 MB of text."""
    out = {c: np.zeros(len(column), dtype=np.int64) for c in COUNTS}
    for first, data, offsets in text_slices(column):
        n = len(offsets) - 1
        at = slice(first, first + n)
        starts, ends, owner = words(data, offsets)
        out["n_words"][at] = np.bincount(owner, minlength=n)
        out["word_chars"][at] = _per_text(((data & 0xC0) != 0x80) & ~WHITE[data], offsets)
        for name, kind in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_marks", MARK), ("n_letters", LETTER)):
            out[name][at] = _per_text(kind[data], offsets)
        if not len(starts):
            continue
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        # Lines: from each text's start and each line end to the next; those without a word are left out.
        breaks = np.flatnonzero(data == 10)
        begins = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1)
        begins = begins[begins < len(data)]
        stops = np.minimum(np.append(begins[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, begins)])
        filled = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
        begins, stops = begins[filled], stops[filled]
        line_owner = np.searchsorted(offsets, begins, side="right") - 1
        keys = mix(word_hashes(data, begins, stops) + salt[line_owner])
        out["n_lines"][at] = np.bincount(line_owner, minlength=n)
        out["n_dup_lines"][at] = np.bincount(line_owner[_duplicates(keys)[1]], minlength=n)
        m = len(starts) - WINDOW + 1
        if m > 0:
            hashes = word_hashes(data, starts, ends)
            total = np.zeros(m, dtype=np.uint64)
            for j, factor in enumerate(powers(0xD6E8FEB86659FD93, WINDOW + 1)[1:]):
                total += hashes[j : j + m] * factor
            places = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
            found = places[_duplicates(mix(total[places] + salt[owner[places]]))[0]]
            edge = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + WINDOW, -1)
            out["n_repeat_words"][at] = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=n)
    return out


def rates(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    share = lambda a, b: np.minimum(1.0, counts[a] / np.maximum(counts[b], 1))
    return {
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "n_letters"), "marks": share("n_marks", "word_chars"),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, counts), a row per input row. Null and empty texts count nothing; a null stratum is a stratum of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = measure(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[c]) for c in COUNTS]], ["doc_id", "stratum", *COUNTS])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), _stratum(stratum_column).alias("stratum"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def _stratum(column: str | None):
    return F.lit("all") if column is None else F.coalesce(F.col(column).cast("string"), F.lit(""))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at probability p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def passing_cutoffs(good_above: list[int], n_good: int, risk: float, level: float) -> int:
    """How many cutoffs, from the laxest, pass; ``good_above`` counts the good documents that each would reject."""
    for i, k in enumerate(good_above):
        if k > risk * n_good or binomial_tail(k, n_good, risk) > level:
            return i
    return len(good_above)


def choose_cutoffs(measured_docs: DataFrame, labels: DataFrame, risk: float = RISK, miss: float = MISS, label_id: str = "doc_id", label: str = "quality") -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}} from the labelled documents that pass the base rules.

    A document with several labels counts once, as bad if any says so; null labels are left out. Rates are first counted by
    (stratum, label, rule, grid step) where they lie, so that what comes to the driver grows with the strata alone.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.min(label).cast("int").alias("good"))
    known = measured_docs.join(marked, "doc_id").where(f"n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED_PERCENT} * n_words")
    steps = np.array(GRID[::-1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = rates({c: frame[c].to_numpy() for c in COUNTS})
            # Step i: the rate lies above GRID[i] and all stricter cutoffs, and not above the laxer ones.
            parts = [
                pd.DataFrame({"stratum": frame["stratum"], "good": frame["good"], "rule": rule, "step": len(steps) - np.searchsorted(steps, found[rule], side="left")})
                for rule in RULES
            ]
            yield pd.concat(parts).groupby(["stratum", "good", "rule", "step"], as_index=False).size().rename(columns={"size": "n"})

    counted = known.mapInPandas(run, "stratum string, good int, rule string, step int, n long").groupBy("stratum", "good", "rule", "step").agg(F.sum("n").alias("n")).toPandas()
    good_by = counted[(counted["rule"] == RULES[0]) & (counted["good"] == 1)].groupby("stratum")["n"].sum()
    strata = sorted(counted["stratum"].unique())
    level = miss / ((len(strata) + 1) * len(RULES))
    needed = math.log(level) / math.log1p(-risk / len(RULES))
    few = [s for s in strata if good_by.get(s, 0) < needed]
    counted.loc[counted["stratum"].isin(few), "stratum"] = REST
    strata = sorted(counted["stratum"].unique())
    out: dict[str, dict[str, float]] = {}
    for stratum in strata:
        own = counted[counted["stratum"] == stratum]
        out[stratum] = {}
        for rule in RULES:
            per = {g: np.bincount(x["step"], weights=x["n"], minlength=len(GRID) + 1) for g, x in own[own["rule"] == rule].groupby("good")}
            good, bad = (per.get(g, np.zeros(len(GRID) + 1)) for g in (1, 0))
            good_above, bad_above = (np.cumsum(x)[: len(GRID)].astype(int).tolist() for x in (good, bad))
            n_good, n_bad = int(good.sum()), int(bad.sum())
            passed = passing_cutoffs(good_above, n_good, risk / len(RULES), level)
            gains = [bad_above[i] / max(1, n_bad) - 10 * good_above[i] / max(1, n_good) for i in range(passed)]
            if gains and max(gains) > 0:
                out[stratum][rule] = GRID[gains.index(max(gains))]
    return out


def kept_flags(counts: dict[str, np.ndarray], strata: list[str], cutoffs: dict[str, dict[str, float]]) -> np.ndarray:
    found = rates(counts)
    kept = ~base_failed(counts)
    names, codes = np.unique(np.array(strata, dtype=object).astype(str), return_inverse=True) if len(strata) else ([], np.zeros(0, dtype=int))
    for rule in RULES:
        limit = np.array([cutoffs.get(s, cutoffs.get(REST, {})).get(rule, 2.0) for s in names])
        if len(limit):
            kept &= found[rule] <= limit[codes]
    return kept


def judged(measured_docs: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """``measured_docs`` with base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS}
            flags = [pa.array(base_failed(counts)), pa.array(kept_flags(counts, batch.column("stratum").to_pylist(), cutoffs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], [*batch.schema.names, "base_failed", "kept"])

    schema = ", ".join(f"`{n}` {t}" for n, t in measured_docs.dtypes)
    return measured_docs.mapInArrow(run, f"{schema}, base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, cutoffs: dict[str, dict[str, float]], text_column: str = "text", stratum_column: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that all rules keep, with its own columns: no shuffle, texts are measured where they are."""
    names = docs.columns
    text, stratum = names.index(text_column), None if stratum_column is None else names.index(stratum_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strata = ["all"] * batch.num_rows if stratum is None else [s or "" for s in batch.column(stratum).to_pylist()]
            yield batch.filter(pa.array(kept_flags(measure(batch.column(text)), strata, cutoffs)))

    return docs.mapInArrow(run, docs.schema)
