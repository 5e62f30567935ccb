"""SimHash, the Jaccard join, components and the chat tree against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import chat, components, jaccard, quality_rules, queries, simhash
from compare import compare
from llm.helpers import SENTENCE, TEXTS, documents, jaccard_brute, plain


def near_copies(seed=4, n=90):
    draw, vocabulary = random.Random(seed), [f"w{i}" for i in range(400)]
    base = [draw.choice(vocabulary) for _ in range(60)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(30))
    out = []
    for i in range(n):
        words = base.copy()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = draw.choice(vocabulary)
        out.append(" ".join(words))
        out.append(passage + " " + " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 60))))
    return out


@pytest.mark.parametrize("sparse, chunk, block", [(64, 256, 2_000_000), (1, 7, 300), (5, 20, 1000)])
def test_jaccard_classes_and_links(spark, monkeypatch, sparse, chunk, block):
    for name, value in (("SPARSE_COLUMN", sparse), ("CHUNK", chunk), ("ROW_BLOCK", block), ("COLUMN_BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    texts = TEXTS + near_copies()
    docs = documents(spark, texts, {"id": F.lit(1), "columns": F.lit(2), "n": F.lit(3)})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.joined(docs).collect()}
    assert got == jaccard_brute(list(enumerate(texts)))


def test_a_column_of_all_documents_is_one_entry_of_a_row_block(spark, monkeypatch):
    """One n-gram in all documents: its column block gets an entry for each row block, however many rows that has."""
    for name, value in (("ROW_BLOCK", 3000), ("COLUMN_BLOCK", 500)):
        monkeypatch.setattr(jaccard, name, value)
    draw = random.Random(8)
    texts = ["all of them share this " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(20)) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    matrix = jaccard._matrix(docs, 100, 5)
    entries = [len(r.rows) // 4 for r in matrix.where("octet_length(rows) > 0").collect()]
    blocks = matrix.where("octet_length(ids) > 0").count()
    assert sum(entries) == 2000 * 20 + blocks and blocks < 40
    per_bucket = matrix.groupBy("bucket").agg(F.sum(F.octet_length("rows") / 4).alias("n")).collect()
    assert max(r.n for r in per_bucket) < 600
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.joined(docs).collect()}
    assert got == {i: (21, i, 0) for i in range(2000)}


def test_words_built_to_collide_stay_apart(spark):
    """A Thue-Morse word and its complement: polynomials modulo a power of two cannot tell them apart."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    pair = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    longer = ["".join(("abcdefgh", "hgfedcba")[b] for b in bits), "".join(("hgfedcba", "abcdefgh")[b] for b in bits)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.joined(documents(spark, pair + longer)).collect()}
    assert got == {i: (i, 0) for i in range(4)}
    for x, y in (pair, longer):
        assert quality_rules.measure(pa.array([f"{x}\n{y}\n{x}"]))["n_dup_lines"].tolist() == [1]


def test_jaccard_of_awkward_tables(spark):
    docs = documents(spark)
    assert jaccard.joined(docs.limit(0)).count() == 0
    twice = docs.union(docs).union(documents(spark, [SENTENCE]).withColumn("doc_id", F.lit(None).cast("long")))
    got = plain(jaccard.joined(twice))
    assert len(got) == 2 * len(TEXTS) + 1 and got[got.doc_id.isna()].component_id.isna().all()
    own = got[got.doc_id.notna()]
    want = jaccard_brute(list(enumerate(TEXTS)))
    assert {int(i): (n, int(c)) for i, n, c in zip(own.doc_id, own.n_shingles, own.component_id)} == {i: w[:2] for i, w in want.items()}
    kept = jaccard.one_of_each(docs, jaccard.joined(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[1] == i}


def test_jaccard_query_on_the_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in queries.op10_jaccard_join(spark, sf_dir).collect()}
    assert got == jaccard_brute([(r.doc_id, r.text) for r in docs])


def test_jaccard_query_equals_sql(spark, con, sf_dir):
    problems, _, rows = compare(spark, con, "op10", queries.op10_jaccard_join, queries.ORACLE["op10_jaccard_join"], sf_dir)
    assert not problems and rows > 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, 8: 8, 9: 8}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_follow_the_text(spark, sf_dir):
    prints = simhash.fingerprints(pa.array([SENTENCE, SENTENCE, SENTENCE + " again", "other words altogether here", None, "", "a"]))
    assert np.array_equal(prints[0], prints[1]) and not prints[4].any() and not prints[5].any() and prints[6].any()
    like = simhash.likeness(prints[:1], prints)
    assert like[1] == 1 and 0.7 < like[2] < 1 and like[3] < 0.6


@pytest.mark.parametrize("partitions", [1, 4])
def test_edited_texts_and_neighbours(spark, partitions):
    docs = documents(spark, extra={"extra": F.lit(1), "stretch": F.lit(2), "key": F.lit(3)})
    got = plain(simhash.compared(docs, partitions)).sort_values("doc_id")
    texts = [t or "" for t in TEXTS]
    after = texts[1:] + texts[:1]
    other = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for t, a in zip(texts, after)]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in other] and got.n_chars.tolist() == [len(t) for t in texts]
    own, changed = simhash.fingerprints(pa.array(texts)), simhash.fingerprints(pa.array(other))
    assert got.fingerprint.tolist() == simhash.hexed(own) and got.edited_fingerprint.tolist() == simhash.hexed(changed)
    assert np.allclose(got.near_edited, simhash.likeness(own, changed)) and np.allclose(got.near_next, simhash.likeness(own, np.roll(own, -1, axis=0)))


def test_neighbours_of_few_and_repeated_rows(spark):
    assert simhash.compared(documents(spark).limit(0)).count() == 0
    one = plain(simhash.compared(documents(spark, [SENTENCE])))
    assert one.near_next.tolist() == [1.0]
    docs = documents(spark, ["b c d", "e f g"])
    again = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert len(plain(simhash.compared(again, 3))) == 6


@pytest.mark.parametrize("radius, full", [(3, 32), (3, 1), (1, 2), (5, 4)])
def test_block_tables_find_all_pairs(spark, monkeypatch, radius, full):
    monkeypatch.setattr(simhash, "FULL_BUCKET", full)
    draw = random.Random(2)
    base = [draw.getrandbits(128) for _ in range(6)]
    values = base + [b ^ sum(1 << k for k in draw.sample(range(128), draw.randint(1, 6))) for b in base for _ in range(15)]
    prints = spark.createDataFrame([(f"{v:032x}",) for v in [*values, *base]], "fingerprint string")
    got = {(r.a, r.b, r.distance) for r in simhash.near_pairs(prints, radius).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= radius}


def test_near_counts_count_copies(spark):
    rows = spark.createDataFrame([(1, "0" * 32), (2, "0" * 32), (3, "0" * 31 + "1"), (4, "f" * 32)], "doc_id long, fingerprint string")
    assert {r.doc_id: r.n_near for r in simhash.with_near_counts(rows).collect()} == {1: 2, 2: 2, 3: 2, 4: 0}


@pytest.mark.parametrize("full, piece", [(50_000, 4096), (40, 7)])
def test_near_pairs_of_the_registered_radius_are_exact(spark, monkeypatch, full, piece):
    monkeypatch.setattr(simhash, "FULL_BUCKET", full)
    monkeypatch.setattr(simhash, "PIECE", piece)
    draw = random.Random(4)
    base = [draw.getrandbits(128) for _ in range(8)]
    values = base + [b ^ sum(1 << k for k in draw.sample(range(128), draw.randint(1, 16))) for b in base for _ in range(25)]
    prints = spark.createDataFrame([(i, f"{v:032x}") for i, v in enumerate([*values, *base])], "doc_id long, fingerprint string")
    want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= simhash.RADIUS}
    got = [(r.a, r.b, r.distance) for r in simhash.near_pairs(prints).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    every = [*values, *base]
    counts = {r.doc_id: r.n_near for r in simhash.with_near_counts(prints).collect()}
    assert counts == {i: sum((a ^ b).bit_count() <= simhash.RADIUS for b in every) - 1 for i, a in enumerate(every)}


def test_texts_with_few_changed_words_are_near(spark):
    draw = random.Random(6)
    texts = []
    for _ in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changed in (1, 2):
            other = list(words)
            for k in draw.sample(range(200), changed):
                other[k] = f"new{draw.randrange(5000)}"
            texts.append(" ".join(other))
    got = plain(simhash.with_near_counts(simhash.compared(documents(spark, texts)))).sort_values("doc_id").n_near.to_numpy()
    assert (got <= 2).all() and (got > 0).mean() > 0.97 and got.mean() > 1.8


def test_simhash_query_tells_edits_from_strangers(spark, sf_dir):
    got = plain(queries.op9_simhash(spark, sf_dir))
    got = got[got.n_chars > 200]
    assert got.near_edited.median() > 0.6 > 0.3 > got.near_next.median()


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("piece", F.lit("own")).withColumn("key", F.lit("own")).repartition(3)


def test_escapes_are_reversible():
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice([*chat.CONTROLS, "\\", "<", "[", "s>", "l", "b", "\n", "x"]) for _ in range(draw.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
        assert chat.parse_turn(chat.format_turn(text, text)[0]) == (text, text)


def test_chat_tree_is_shared_and_read_back(spark):
    said = {0: "abc", 1: "abd", 2: "abde", 3: "x", 4: "abdf", 5: "abc", 6: "ab"}
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", c * 3) for k, text in said.items() for t, c in enumerate(text)]
    rows += [(8, 0, None, None), (8, 1, "assistant", None), (9, 0, "user", "</s>[INST] ok [/INST]"), (9, 0, "user", "again"), (9, None, "system", "\\n<s>"), (None, 0, "user", "no id")]
    nodes, members = chat.formatted(turns(spark, rows))
    tree = {r.node_id: r for r in nodes.collect()}
    assert len(tree) == len({text[:i] for text in said.values() for i in range(1, len(text) + 1)}) + 2 + 3 + 1
    for r in tree.values():
        path, at = [], tree.get(r.parent_id)
        while at:
            path.append(at)
            at = tree.get(at.parent_id)
        filled = {x for a in path for x in range(a.offset, a.offset + a.n_chars)}
        assert {x for begin, end in r.ancestors for x in range(begin, end)} == filled and r.position == len(filled)
    for tree_id in {r.tree_id for r in tree.values()}:
        own = sorted((r.offset, r.n_chars) for r in tree.values() if r.tree_id == tree_id)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    got = {r.conv_id: r for r in chat.read_back(nodes, members).collect()}
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    for conv, own in by.items():
        learned = "".join(t for r, t in own if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(own) and row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert row.loss_chars == len(learned) and row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_of_nothing(spark):
    assert chat.read_back(*chat.formatted(turns(spark, []))).count() == 0


def test_chat_query_on_the_given_tables(spark, sf_dir):
    by = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op5_chat_tree(spark, sf_dir).collect()}
    assert set(got) == {*by, -1} and got[-1].loss_chars == 21
    for conv, own in by.items():
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
