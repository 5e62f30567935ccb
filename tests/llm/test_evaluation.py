"""Decontamination, ranked search and hard negatives against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import decontaminate, lexical, negatives, queries
from compare import compare
from llm.helpers import LOWER, TEXTS, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NUMBERED = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [
    (1, NUMBERED), (10, "The QUICK brown fox, jumps over the lazy dog and then runs"), (2, "漢字"), (3, None), (4, ""), (5, "... !"), (None, "the"),
    (6, "word word word word word word word word word word word"), (7, NUMBERED), (7, "z z"),
]
ABOUT = [
    f"É so: {NUMBERED.upper()}!", NUMBERED.replace(" ", "\n--"), NUMBERED[:-7], "one two three four five six seven eight nine ten " * 2, "漢字 x 漢字", "z z z", "xx z zz z",
    "漢字é", "a_b-c z\x00z",
]


def said(text):
    return TERM.findall((text or "").translate(LOWER))


def decontaminated_brute(texts, items, width=10):
    found = defaultdict(set)
    for item, text in items:
        w = said(text)
        if item is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                found[tuple(w[i : i + width])].add(str(item))
    out = []
    for text in texts:
        w, hit, ids = said(text), set(), set()
        for n in {len(p) for p in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    ids |= found[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return out


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


@pytest.mark.parametrize("part_bytes, step", [(None, 1 << 20), (60, 7)])
def test_decontamination(spark, monkeypatch, part_bytes, step):
    monkeypatch.setattr(decontaminate, "STEP_CHARS", step)
    texts = TEXTS + ABOUT
    docs = documents(spark, texts, {"items": F.lit("own"), "Spans": F.lit(7), "place": F.lit(1)})
    got = decontaminate.decontaminated(docs, benchmark(spark), part_bytes=part_bytes)
    assert got.columns[: len(docs.columns)] == docs.columns and {"_items", "_spans"} <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    want = decontaminated_brute(texts, ITEMS)
    assert {i: (r.n_words, r.n_hit, r.n_items, r._items, r.contaminated) for i, r in rows.items()} == dict(enumerate(want))
    for i, text in enumerate(texts):
        for s in rows[i]._spans:
            assert said(text)[s.first_word : s.end_word] == said(text[s.start : s.end])
            assert TERM.match(text[s.start].lower()) and TERM.match(text[s.end - 1].lower())
        assert sum(s.end_word - s.first_word for s in rows[i]._spans) == rows[i].n_hit


def test_decontamination_of_awkward_tables(spark):
    docs = documents(spark, ABOUT)
    assert decontaminate.decontaminated(docs.limit(0), benchmark(spark)).count() == 0
    assert decontaminate.decontaminated(docs, benchmark(spark).limit(0)).where("contaminated or n_items > 0").count() == 0
    twice = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))
    got = decontaminate.decontaminated(twice, benchmark(spark))
    assert sorted(r.n_hit for r in got.collect()) == sorted(2 * [w[1] for w in decontaminated_brute(ABOUT, ITEMS)])


def test_passages_are_cut_out(spark):
    docs = documents(spark, ["so " + NUMBERED + ", ünd z z!", "clean", None])
    found = decontaminate.decontaminated(docs, benchmark(spark))
    got = {r.doc_id: r.text for r in decontaminate.without_passages(docs, found).collect()}
    assert got == {0: "so , ünd !", 1: "clean", 2: None}


def test_stretches_merge():
    assert decontaminate.merged([(5, 8), (0, 3), (3, 4), (6, 7)]) == [(0, 4), (5, 8)]
    assert decontaminate.merged([(2, 6, 20, 60), (0, 3, 1, 33), (2, 4, 20, 40)]) == [(0, 6, 1, 60)]


def ranked_brute(texts, items, k=10):
    """Straight from the statement of the score; ``texts`` are (doc_id, text)."""
    counts = [(i, Counter(said(t))) for i, t in texts if said(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(said(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def made_texts(seed=9, n=160):
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 12))) for _ in range(n)]
    return texts + texts[:40] + [texts[0]] * 30 + [" ".join(reversed(texts[1].split()))]


@pytest.mark.parametrize("group_bytes, scores, products", [(None, 2_000_000, 1_000_000), (100, 3, 2)])
def test_ranked_search(spark, monkeypatch, group_bytes, scores, products):
    monkeypatch.setattr(lexical, "SCORES", scores)
    monkeypatch.setattr(lexical, "PRODUCTS", products)
    texts = TEXTS + made_texts()
    items = [(i, t) for i, t in enumerate(made_texts(3, 12)[:12])] + ITEMS[1:] + [(0, "v1 v1 v2")]
    docs = documents(spark, texts, {"bag": F.lit(1), "n": F.lit(2), "key": F.lit(3), "score": F.lit(4)})
    docs = docs.union(docs.where("doc_id in (0, 20)")).union(docs.where("doc_id = 25").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [*enumerate(texts), (0, texts[0]), (20, texts[20]), (None, texts[25])]
    got = lexical.ranked(docs, benchmark(spark, items), group_bytes=group_bytes)
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == ranked_brute(rows, items)


def test_ranked_search_of_awkward_tables(spark):
    docs = documents(spark)
    for d, b in ((docs.limit(0), benchmark(spark)), (docs, benchmark(spark).limit(0)), (documents(spark, [None, "", "!"]), benchmark(spark))):
        got = lexical.ranked(d, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def mined_brute(rows, picked, n_positive=5, k=10):
    """``rows`` are (vec_id, label, components as whole numbers)."""
    out = []
    for a, label, v in picked:
        score = [(-int(np.dot(v, w)), i, own) for i, own, w in rows]
        positives = sorted((s, i) for s, i, own in score if own == label and i != a)[:n_positive]
        for s, p in positives:
            fits = sorted((t, i) for t, i, own in score if own != label and 30 * -s <= 100 * -t <= 90 * -s)[:k]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def made_vectors(seed=5, n=400, dims=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, dims))
    labels = draw.integers(0, 4, n)
    x = centres[labels] + draw.normal(size=(n, dims))
    x[::9] = x[0]  # one vector that many rows share
    x[5] = 0
    return [(i, int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(labels, x))]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("cell_rows, cell_anchors, step", [(16_384, 16_384, 16), (50, 3, 1)])
def test_hard_negatives(spark, monkeypatch, cell_rows, cell_anchors, step):
    for name, value in (("CELL_ROWS", cell_rows), ("CELL_ANCHORS", cell_anchors), ("FIRST_STEP", step)):
        monkeypatch.setattr(negatives, name, value)
    rows = made_vectors()
    nan = float("nan")
    awkward = [
        (1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, 2, [nan] * 6), (1004, 2, [float("inf")] * 6), (None, 1, [1.0] * 6),
    ]
    table = vectors(spark, rows + awkward).withColumn("v", F.lit(1)).withColumn("anchor", F.lit(2))
    quantised = negatives.quantised(table)
    got = negatives.mined(quantised, quantised.where("vec_id % 5 = 0"))
    whole = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == mined_brute(whole, [r for r in whole if r[0] % 5 == 0])


def test_hard_negatives_of_awkward_tables(spark):
    table = vectors(spark, [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, []), (3, 2, []), (4, 1, [])])
    quantised = negatives.quantised(table)
    assert negatives.mined(quantised.limit(0), quantised.limit(0)).count() == 0
    assert negatives.mined(quantised, quantised.limit(0)).count() == 0
    got = sorted(tuple(r) for r in negatives.mined(quantised, quantised.where("vec_id = 0")).collect())
    one = [(0, 1, 1, 2, 65536, 32768), (0, 4, 1, 3, 0, 0), (0, 4, 2, 3, 0, 0)]
    assert got == sorted(one + one)


def test_threshold_stops_before_all_rows_are_scored():
    draw = np.random.default_rng(1)
    rows = (256 * draw.normal(size=(5000, 3))).astype(np.int64)
    lists = negatives.Lists(np.arange(5000), draw.integers(0, 2, 5000), rows, 1000)
    (scores, ids), = lists.best(np.array([300, -20, 5]), -1, 0, False, [negatives.ANYTHING], 10)
    every = rows @ np.array([300, -20, 5])
    want = sorted((-s, i) for i, s in enumerate(every.tolist()) if lists.labels[i] != 0)[:10]
    assert list(zip((-scores).tolist(), ids.tolist())) == want and lists.scored < 1000


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_lexical_search", "op13_hard_negatives"])
def test_query_equals_sql(spark, con, sf_dir, name):
    problems, _, rows = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert not problems, "\n".join(problems)
    assert rows > 0
