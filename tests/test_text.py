"""Chunking, whitespace, tokens and truncation against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import records as R, text as T
from chunkloom.operators import chunks as C

BLANKS = [chr(i) for i in range(0x3001) if chr(i).isspace()]
DEMO = "这是一个 Day 7 的端到端演示文档。\n它主要介绍了当前系统已经支持：\n1. 文档上传\n2. 文档切片与向量索引\n"


def random_text(seed, n):
    rng = random.Random(seed)
    pool = "abcdé中😀" * 6 + "".join(BLANKS) + "\n\n\r"
    return "".join(rng.choice(pool) for _ in range(n))


TEXTS = ["", "   ", "\n\n", "x" * 800, "x" * 801, "y" * 1500, "z" * 1501, "a\r\nb\rc  \n\n\n\nd\t\n", DEMO, "😀" * 1700]
TEXTS += [random_text(seed, seed * 97) for seed in range(1, 30)]


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = rows.select("i", expression(F.col("text")).alias("out")).collect()
    return [r.out for r in sorted(got, key=lambda r: r.i)]


def test_normalize(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "a \t\nb": "a\nb", "a\n\n\n\nb": "a\n\nb", " \n a b \n ": "a b", "a\n \n\t\nb": "a\n\nb", "": "", None: ""}
    assert column(spark, list(cases), T.normalize_document_text) == list(cases.values())
    clean = column(spark, TEXTS, T.normalize_document_text)
    assert column(spark, clean, T.normalize_document_text) == clean
    for before, after in zip(TEXTS, clean):
        assert "\r" not in after and "\n\n\n" not in after and after == after.strip()
        assert not any(x.isspace() and x != "\n" and y == "\n" for x, y in zip(after, after[1:]))
        assert "".join(before.split()) == "".join(after.split())


@pytest.mark.parametrize("size,overlap", [(800, 100), (50, 0), (50, 25), (50, 40), (7, 6)])
def test_chunks_cover_the_text(spark, size, overlap):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in C.chunk_documents(rows, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
        assert r.chunk_index == len(got[r.doc_id]) - 1
    for i, text in enumerate(column(spark, TEXTS, T.normalize_document_text)):
        pieces = got.get(i, [])
        assert all(p and p == p.strip() and len(p) <= size and p in text for p in pieces)
        step = size - overlap
        assert all(any(part in p for p in pieces) for k in range(0, len(text), step) if (part := text[k : k + step].strip()))
        assert len(pieces) <= max(0, -(-(len(text) - size) // step)) + 1


def test_neighbouring_chunks_share_the_overlap(spark):
    rows = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "abcdefghij"), (3, " "), (4, "abc      defg")], "doc_id long, text string")
    got = {}
    for r in C.chunk_documents(rows, 10, 4).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {1: ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxyz"], 2: ["abcdefghij"], 4: ["abc      d", "defg"]}


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, -1), (10, 10)])
def test_bad_chunking(size, overlap):
    with pytest.raises(ValueError):
        T.check_chunking(size, overlap)


def test_window_counts(spark):
    lengths = spark.createDataFrame([(10_000,), (100_000,), (1_000_000,), (10_000_000,), (0,), (800,), (801,)], "n long")
    got = [r.c for r in lengths.select(T.window_count(F.col("n")).alias("c")).collect()]
    assert got == [15, 143, 1429, 14286, 0, 1, 2]


def test_tokens(spark):
    def tokens(t):
        words = len(t.split())
        return words if words > 1 else len(t.strip())

    assert column(spark, TEXTS, T.estimate_tokens) == [tokens(t) for t in TEXTS]


def test_strip_and_collapse(spark):
    assert column(spark, TEXTS, T.strip) == [t.strip() for t in TEXTS]
    assert column(spark, TEXTS, T.rstrip) == [t.rstrip() for t in TEXTS]
    assert column(spark, TEXTS, T.collapse_whitespace) == [" ".join(t.split()) for t in TEXTS]


def test_pieces(spark):
    expected = [[t[i : i + 20] for i in range(0, len(t), 20)] for t in TEXTS]
    assert column(spark, TEXTS, lambda c: T.fixed_pieces(c, 20)) == expected


def test_snippets(spark):
    flat = [t.strip().replace("\n", " ") for t in TEXTS]
    assert column(spark, TEXTS, T.build_snippet) == [t if len(t) <= 180 else t[:180] + "..." for t in flat]


def test_truncations(spark):
    once = lambda t: t if len(t) <= 1000 else t[:1000] + " ..."
    twice = lambda t: t if len(t) <= 1000 else t[:1000].rstrip() + "\n...[truncated]"
    assert column(spark, TEXTS, lambda c: T.truncate_hit(c, 1000)) == [once(t) for t in TEXTS]
    both = lambda c: T.truncate_prompt(T.truncate_hit(c, 1000), 1000)
    assert column(spark, TEXTS, both) == [twice(once(t)) for t in TEXTS]


def test_identity(spark):
    cases = {"": "unknown", "a b": "a_b", "é": "__", "x" * 90: "x" * 80, "A-z_0.@": "A-z_0.@", None: "unknown"}
    assert column(spark, list(cases), R.sanitize_identity) == list(cases.values())


def test_timeouts(spark):
    cases = {"Timeout!": True, "read TIMED OUT": True, "time out": False, None: False}
    assert column(spark, list(cases), R.is_timeout) == list(cases.values())


def test_file_names(spark):
    names = {"a.MD": "md", "x.tar.gz": "gz", "none": "", ".hidden": "hidden", None: ""}
    assert column(spark, list(names), R.file_extension) == list(names.values())
    assert column(spark, ['a/b:c*?"<>|\\', ""], R.sanitize_file_name) == ["a_b_c_______", "upload.bin"]


def test_content_parts(spark):
    cases = {
        '["a", {"type": "text", "text": "b"}, {"type": "image", "text": "c"}, null, {"type": "input_text"}]': "ab",
        '"plain"': "plain",
        '"[not a list"': "[not a list",
        None: None,
    }
    assert column(spark, list(cases), lambda c: R.flatten_content(F.try_parse_json(c))) == list(cases.values())
