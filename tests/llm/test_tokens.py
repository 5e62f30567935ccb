"""Packing, byte-level BPE and token files against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkloom.llm import byte_bpe, packing, queries, token_files, tokens as tokenizing
from chunkloom.session import written
from llm.helpers import TEXTS, documents, plain

PACK, FILES, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def library_ids(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("length", [1024, 7, 1])
def test_pieces_cover_every_document_once(spark, length):
    texts = TEXTS[:12] if length < 1024 else TEXTS
    docs = documents(spark, texts, {"ids": F.lit("taken"), "offset": F.lit(1)})
    got = plain(packing.packed_documents(docs, PACK, 0, length))
    want = library_ids(PACK, texts, 0)
    assert set(got.doc_id) == set(range(len(texts)))
    for doc_id, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        assert b"".join(own.ids) == packed(want[doc_id]) and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert (own.doc_tokens == len(want[doc_id])).all() and (own.crosses == (len(own) > 1)).all()
    per = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((own.offset.to_numpy() == np.cumsum(own.length) - own.length).all() for _, own in per)
    sums = per.length.sum()
    assert sums.index.tolist() == list(range(len(sums))) and (sums.iloc[:-1] == length).all() and sums.iloc[-1] <= length


def test_sequences_are_padded_but_for_powers_of_two(spark):
    got = plain(packing.sequences(packing.packed_documents(documents(spark), PACK, 0, 1024), 1024, pad_id=5))
    for row in got.itertuples():
        assert len(row.input_ids) == packing.padded_length(row.n_used) and set(row.input_ids[row.n_used :]) <= {5}
    assert [packing.padded_length(n) for n in (1, 2, 3, 512, 700, 1024)] == [1, 2, 1024, 512, 1024, 1024]


def test_pieces_are_cut_without_python_workers(spark):
    tokens = packing.tokenized(documents(spark), PACK, 0)
    stored = written(tokens, "tokens")
    pieces = packing.pack(stored, 16)
    assert "InArrow" not in pieces._jdf.queryExecution().toString()
    for row in plain(pieces).itertuples():
        assert row.crosses == (row.length < row.doc_tokens) and len(row.ids) == 4 * row.length and row.offset + row.length <= 16


def test_packing_nothing(spark):
    assert packing.packed_documents(documents(spark).limit(0), PACK, 0).count() == 0
    assert packing.packed_documents(documents(spark, ["", None]), PACK, None).count() == 0
    with pytest.raises(ValueError):
        packing.pack(packing.tokenized(documents(spark), PACK, 0), 0)


ODD_STRINGS = [
    "a", "Bc", "word", "É", "ÿ", "ſ", "ŉ", "İ", "Σ", "ǅ", "漢", "e\u0301", "\u0338", "7", ".", ",", "=", ">", "-", "'", "'s", "'RE", "…", "_", "<|endoftext|>", "<|startoftext|>", "<|",
    "|>", "\0", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "🙂",
]


def test_pieces_join_to_the_ids_of_whole_texts():
    draw = random.Random(3)
    texts = [*ODD_STRINGS, *(a + b + c for a in ("", "a", "É") for b in ODD_STRINGS for c in ODD_STRINGS)]
    texts += ["".join(draw.choices(ODD_STRINGS, k=draw.randint(3, 14))) for _ in range(4_000)]
    for path in (PACK, FILES):
        assert list(tokenizing.library_encoder(path).encode(texts)) == [packed(i[:-1]) for i in library_ids(path, texts, 0)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_file(RANKS), special_tokens={})
    assert list(byte_bpe.encoder(RANKS, public_tokenizers.PATTERN).encode(texts)) == [packed(library.encode_ordinary(t)) for t in texts]


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    text = "so qzvxkj. Then qzvxkj, or qzvxkj; (qzvxkj)\nqzvxkj qzvxkj!\nThe qzvxkj.\nqzvxkj"
    for path in (PACK, FILES):
        own, asked = tokenizing.library_encoder(path), []
        make = own.words.make
        monkeypatch.setattr(own.words, "make", lambda words: asked.extend(words) or make(words))
        assert list(own.encode([text, text])) == [packed(library_ids(path, [text], 0)[0][:-1])] * 2
        assert list(own.encode([text + " qzvxkj:", "qzvxkj? " + text]))  # of what is known nothing is asked again
        assert max(map(asked.count, asked)) == 1 and {a for a in asked if "qzv" in a} <= {"qzvxkj", " qzvxkj"}
        assert {k.strip() for k in own.pieces.known if "qzv" in k} == {"qzvxkj", "(qzvxkj"}


def test_token_files_read_back(spark):
    docs = documents(spark).union(documents(spark, [TEXTS[0]] * 2)).union(documents(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    tokens = written(packing.tokenized(docs, FILES, 2), "tokens")
    path = token_files.token_file_path(spark)
    token_files.write_token_files(tokens, path, partitions=4)
    got = plain(token_files.read_token_files(spark, path)).sort_values("start")
    keys = [-1 if k is None or k != k else int(k) for k in got.doc_id]
    assert keys == sorted(keys) and keys.count(0) == 2 and keys.count(-1) == 1
    want = library_ids(FILES, [*TEXTS, "no id"], 2)
    assert [bytes(x) for x in got.ids] == [packed(want[k]) for k in keys]
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]


def test_token_files_of_nothing(spark):
    path = token_files.token_file_path(spark)
    token_files.write_token_files(packing.tokenized(documents(spark).limit(0), FILES, 2), path)
    assert token_files.read_token_files(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=12), max_size=6))
def test_coded_ranks_round_trip(texts):
    sizes, numbers = np.array([len(t) for t in texts], dtype=np.int64), [n for t in texts for n in t]
    control, data = token_files.encode_ranks(np.array(numbers, dtype=np.uint32), sizes)
    assert token_files.decode_ranks(b"".join(control), b"".join(data), sizes).tolist() == numbers
    assert [len(c) for c in control] == [-(-len(t) // 4) for t in texts]
    assert [len(d) for d in data] == [sum(max(1, -(-n.bit_length() // 8)) for n in t) for t in texts]


def test_rank_queue_merges_as_the_library_does():
    ranks = byte_bpe.rank_file(RANKS)
    pairs, library = byte_bpe.BytePairs(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    for alphabet in (b"aab", b"the ing", bytes(range(256))):
        for _ in range(400):
            word = bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
            assert pairs.encode(word) == (library._encode_single_piece(word) if word else [])
    long = b"ab" * 20_000 + b"a" * 9_999
    assert pairs.decode(pairs.encode(long)) == long and not pairs.queue.buckets and not pairs.queue.top


def test_byte_bpe_of_whole_texts(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_file(RANKS), special_tokens={})
    docs = documents(spark, extra={"ids": F.lit(1), "decoded": F.lit(2)})
    got = plain(byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS))
    for row in got.itertuples():
        text = TEXTS[row.doc_id] or ""
        assert bytes(row.ids) == packed(library.encode_ordinary(text)) and bytes(row.decoded) == text.encode() and row.n_tokens * 4 == len(row.ids)
    assert byte_bpe.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_queries_on_the_given_tables(spark, sf_dir):
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet")).sort_values("doc_id")
    want = dict(zip(docs.doc_id, library_ids(PACK, docs.text, 0)))
    for row in plain(queries.op1_packing(spark, sf_dir)).itertuples():
        assert row.ids_crc32 == zlib.crc32(packed(want[row.doc_id][row.start : row.start + row.length]))
    got, start = plain(queries.op4_token_files(spark, sf_dir)).set_index("doc_id"), 0
    for doc_id, ids in zip(docs.doc_id, library_ids(FILES, docs.text, 2)):
        row = got.loc[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_file(RANKS), special_tokens={})
    texts = dict(zip(docs.doc_id, docs.text))
    for row in plain(queries.op3_byte_bpe(spark, sf_dir)).itertuples():
        text = texts[row.doc_id] or ""
        assert row.ids_sha256 == hashlib.sha256(packed(library.encode_ordinary(text))).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
