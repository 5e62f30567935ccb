"""Classifier, quality rules, license scans and URL filters."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import classifier, license_scan, quality_rules, queries, url_filter
from compare import compare
from llm.helpers import LOWER, SENTENCE, TEXTS, documents, plain


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_are_those_of_the_text(spark, sf_dir):
    texts = [*TEXTS, "a b c d e f g h " * 2, "\na\n\na\na \n", "#" * 9, *[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]]
    got = quality_rules.measure(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality_rules.COUNTS[:5]) == counts_of(text), i


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (30, 4, 0.2), (50, 50, 0.5)):
        assert math.isclose(quality_rules.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality_rules.passing_cutoffs([0, 0, 2, 2], 1000, 0.01, 0.01) == 4
    assert quality_rules.passing_cutoffs([0, 0, 30, 30], 1000, 0.01, 0.01) == 2
    assert quality_rules.passing_cutoffs([0, 0], 10, 0.01, 0.01) == 0


def test_cutoffs_hold_the_risk_and_find_the_junk(spark):
    good, bad = SENTENCE + " ", re.sub(" ", "### ", SENTENCE)
    texts = [f"{good} {i} {i + 1}" for i in range(900)] + [f"{bad} {i}" for i in range(100)]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 5, "rare").otherwise("en"))
    labels = docs.select("doc_id", (F.col("doc_id") < 900).cast("int").alias("quality"), F.lit(0).alias("kept"))
    labels = labels.union(labels.limit(20)).union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**9, 0, 0)], labels.schema))
    measured = quality_rules.measured(docs)
    cutoffs = quality_rules.choose_cutoffs(measured, labels)
    assert cutoffs["en"]["symbols"] < 0.5
    kept = plain(quality_rules.judged(measured, cutoffs)).set_index("doc_id").kept
    assert kept.loc[range(900)].all() and not kept.loc[range(900, 1000)].any()
    clashing = docs.withColumn("kept", F.lit("own")).withColumn("n_words", F.lit("own"))
    stays = quality_rules.kept_documents(clashing, cutoffs)
    assert stays.columns == clashing.columns and {r.doc_id for r in stays.collect()} == set(kept[kept].index)


def test_rules_without_labels_or_rows(spark):
    docs, labels = documents(spark), spark.createDataFrame([], "doc_id long, quality int")
    measured = quality_rules.measured(docs)
    assert quality_rules.choose_cutoffs(measured, labels) == {}
    got = plain(quality_rules.judged(measured, {})).set_index("doc_id")
    for i, text in enumerate(TEXTS):
        n, _, _, _, repeated = counts_of(text)
        assert got.base_failed[i] == (n < 20 or 100 * repeated > 30 * n) and got.kept[i] == (not got.base_failed[i])
    assert quality_rules.judged(quality_rules.measured(docs.limit(0)), {}).count() == 0


def test_features_are_distinct_and_whole(spark):
    found = dict(classifier.features(pa.array(TEXTS)))
    assert sorted(found) == list(range(len(TEXTS))) and all(len(set(s.tolist())) == len(s) for s in found.values())
    assert len(found[4]) == len(found[5]) == 0 and np.array_equal(np.sort(found[0]), np.sort(found[1]))
    tail = "x" * 5000 + " " + SENTENCE
    slots = dict(classifier.features(pa.array(["x" * 5000, tail])))
    assert len(slots[1]) > len(slots[0]) + 50


def test_dual_coordinate_descent_separates():
    rows = [np.array([i % 2, 2 + i % 3]) for i in range(60)]
    values, signs = [np.ones(2) / math.sqrt(2)] * 60, np.array([1 if i % 2 else -1 for i in range(60)])
    weights, bias = classifier.dual_coordinate_descent(rows, values, signs, np.ones(60), 5)
    assert all(s * (weights[r] @ v + bias) > 0.5 for r, v, s in zip(rows, values, signs))


def test_scales_and_descent_against_a_dense_reference():
    """Log-count ratios from a dense indicator matrix; the hinge objective is within a hundredth of its minimum."""
    draw = np.random.default_rng(3)
    x = draw.random((80, 12)) < draw.random(12)
    x[:, 0] |= ~x.any(axis=1)
    y = np.where(x[:, 1] ^ (draw.random(80) < 0.2), 1, -1)
    rows = [np.flatnonzero(r) for r in x]
    scales = classifier.naive_bayes_scales(rows, y)[:12]
    p, q = 1 + x[y == 1].sum(axis=0), 1 + x[y == -1].sum(axis=0)
    want = np.log((p / (y == 1).sum()) / (q / (y == -1).sum()))
    assert np.allclose(scales, np.where(x.any(axis=0), want, 0))
    dense = x * scales
    dense /= np.maximum(np.sqrt((dense**2).sum(axis=1)), 1e-12)[:, None]
    cost = draw.random(80) + 0.5
    w, b = classifier.dual_coordinate_descent(rows, [d[r] for d, r in zip(dense, rows)], y, cost, 12, rounds=3000)

    def objective(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (dense @ v[:-1] + v[-1]))).sum()

    # Projected subgradient steps from there, and random ones, find nothing lower.
    at = np.append(w, b)
    best = objective(at)
    for scale in (1e-1, 1e-2, 1e-3):
        assert all(objective(at + scale * draw.normal(size=13)) > 0.99 * best for _ in range(300))
    v = np.zeros(13)
    lowest = objective(v)
    full = np.column_stack([dense, np.ones(80)])
    for i in range(1, 20_001):
        wrong = y * (full @ v) < 1
        v = v - (v - (cost * y * wrong) @ full) / (i + 10)
        lowest = min(lowest, objective(v))
    assert best <= 1.01 * lowest


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    texts = [f"{SENTENCE} number {i} and more" for i in range(300)] + [f"buy $$$ now ### {i} !!! click" for i in range(300)]
    docs = documents(spark, texts, {"score": F.lit("own"), "predicted": F.lit("own")})
    labels = docs.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("quality"))
    held = classifier.held_out()
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    flipped = flipped.union(spark.createDataFrame([(None, 1), (7, None)], labels.schema))
    model, same = classifier.train(docs, labels), classifier.train(docs, flipped)
    assert np.array_equal(model.weights, same.weights) and model.offset == same.offset
    got = plain(classifier.scored(docs, model)).set_index("doc_id").sort_index()
    assert (got.predicted == [1] * 300 + [0] * 300).all() and got.score.between(0, 1).all()
    assert classifier.kept_documents(docs, model).columns == docs.columns and classifier.kept_documents(docs, model).count() == 300
    odd = plain(classifier.scored(documents(spark), model))
    assert len(odd) == len(TEXTS) and odd.score.between(0, 1).all()
    assert classifier.scored(docs.limit(0), model).count() == 0


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert set(plain(classifier.scored(documents(spark), classifier.train(documents(spark), labels))).score) == {0.5}


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = plain(queries.op2_classifier(spark, sf).where("held_out").join(labels, "doc_id"))
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.9


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE_PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_sample_is_not_lowered_to_save_memory():
    assert classifier.SAMPLE == 4000 and classifier.training_sample.__defaults__[0] == 4000


def test_license_base_is_counted_exactly(spark, sf_dir):
    texts = [*TEXTS, "under the mit license " * 40, "MIT License", "SPDX-License-Identifier: GPL-3.0", *[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]]
    docs = documents(spark, texts, {"words": F.lit(1), "labels": F.lit(2), "places": F.lit(3)})
    for row in plain(license_scan.scanned(docs)).itertuples():
        n, places = base_places(texts[row.doc_id])
        assert row.n_words == n and row.n_base == len(places)
        assert (row.first_word, row.last_word) == (min(places)[0], max(places)[0]) if places else row.first_word != row.first_word or row.first_word is None
        assert row.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert license_scan.scanned(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Released under the GNU General Public License, version 3 or later.", "gpl-3"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("the 3-clause BSD license", "bsd-3-clause"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
    ("he has a driving licence and sings mit freude", ""),
])
def test_license_rules(spark, text, labels):
    assert plain(license_scan.scanned(documents(spark, [text]))).labels[0] == labels


LICENSE_HEADERS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    (" * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted", "isc"),
    ("Copyright (c) 2011 The Authors. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n# modification, are permitted provided", "bsd"),
    ("Copyright 2011 A Company. All rights reserved.", "proprietary"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
    ("see https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("code is GPLv3", "gpl-3"), ("LGPLv2", "lgpl-2"), ("LGPLv2.1+", "lgpl-2.1"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause) AND ISC AND MPL-2.0 AND Zlib", "bsd-3-clause,gpl-2,isc,mpl-2,zlib"),
    ("Apache-2.0", "apache-2"), ("MPL 2.0", "mpl-2"), ("BSD-2-Clause", "bsd-2-clause"),
    ("the MIT and Apache 2.0 licenses", "apache-2,mit"),
    ("Licensed under MIT or Apache 2.0", "apache-2,mit"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("his licenses expired, the domain was creative and hereby he left a clause", ""),
]


def test_license_texts_notices_and_expressions(spark):
    got = plain(license_scan.scanned(documents(spark, [t for t, _ in LICENSE_HEADERS]))).sort_values("doc_id")
    assert got.labels.tolist() == [labels for _, labels in LICENSE_HEADERS]


def test_hundreds_of_license_rules():
    assert len(license_scan.signature_rules()) > 300


def test_url_query_equals_sql(spark, con, sf_dir):
    problems, _, rows = compare(spark, con, "op8", queries.op8_url_filter, queries.ORACLE["op8_url_filter"], sf_dir)
    assert not problems and rows > 0


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?y#z", "a://net/", "a://net", "a://x.net?/en/", "http://h/p://q", "https://sub.EXAMPLE.com/de/1#a/b", "x://free-bets.org/", "x://notnet/", "x://net/"]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] + [(12, urls[12], "r", "v")], "page_id long, url string, rule string, host string")
    got = plain(url_filter.judged(pages, queries.URL_RULES)).sort_values("page_id")
    assert got.host.tolist() == ["", "", "", "", "example.net", "net", "net", "x.net", "h", "sub.example.com", "free-bets.org", "notnet", "net", "net"]
    assert got.path.tolist() == ["", "", "", "", "/en/x", "/", "", "", "/p://q", "/de/1", "/", "/", "/", "/"]
    assert got.rule.where(got.rule.notna(), None).tolist() == [None] * 4 + ["example.net/en/", "net/"] + [None] * 3 + ["example.com/de/", None, None, "net/", "net/"]
    assert got.verdict.tolist() == ["allow"] * 5 + ["block"] + ["allow"] * 3 + ["block", "block", "allow", "block", "block"]
    assert url_filter.judged(pages.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("most_bits", [None, 512])
def test_cascades_are_exact_over_their_universe(spark, most_bits):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 5000, 37)] + ["k-absent"]
    for given in (listed, spark.createDataFrame([(k,) for k in listed + listed[:5]], "key string")):
        cascades = url_filter.build_cascades(universe, given, most_bits)
        got = {r.key for r in universe.where(url_filter.contains(cascades, F.col("key"))).collect()}
        assert got == set(listed) - {"k-absent"} and len(cascades[0]) > 1 and (len(cascades) > 1) == bool(most_bits)
        assert all(level.bits <= 1024 for c in cascades for level in c) or not most_bits
    assert url_filter.build_cascades(universe, []) == [[]]
    assert universe.where(url_filter.contains([[]], F.col("key"))).count() == 0


def test_a_long_list_is_a_table(spark, monkeypatch):
    """300,000 listed hosts, of which the urls hold some; filters are as large as what the urls hold of the list."""
    monkeypatch.setattr(url_filter, "MOST_BITS", 1 << 13)
    hosts = spark.range(300_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".test")).alias("host"), F.lit("/").alias("path"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), F.col("id") * 200, F.lit(".test/x")).alias("url"))
    pages = pages.union(spark.createDataFrame([(None, "https://h7.test/"), (None, None)], "page_id long, url string"))
    words = spark.createDataFrame([("www",)], "word string")
    got = url_filter.judged(pages, hosts, words)
    assert got.where("page_id is null").count() == 2 and got.where("page_id is null and verdict = 'block'").count() == 1
    known = got.where("page_id is not null")
    assert known.where("rule is not null").count() == 1500 and known.where("verdict = 'block' and listed_word").count() == 2000
