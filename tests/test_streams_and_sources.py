"""Stream filter, SSE text, charsets, upserts and folded state."""

import random
import re

from pyspark.sql import functions as F

from chunkloom.operators import conversations as C, documents as D, metrics as M, tasks as K
from chunkloom.sources import files, sse
from chunkloom.streaming import deltas as W, tasks as ST

THINK = re.compile(r"<think\b[^>]*>.*?(?:</think>|\Z)", re.IGNORECASE | re.DOTALL)
ANSWERS = [
    "plain", "<think>a</think>b", "x<THINK k='1'>a\nb</Think>y<think>z", "a < b <thinker> c", "<think", "tail <th",
    "<think>a</thin</think>b", "one</think>two", "<think></think>", "a<think>b</think>c<think>d</think>e<",
]


def test_filter_on_all_splits():
    rng = random.Random(2)
    for text in ANSWERS:
        expected = THINK.sub("", text)
        for _ in range(200):
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            held, shown = "", ""
            for part in parts:
                more, held = W.feed(held, part)
                shown += more
            assert shown + W.release(held) == expected, (text, parts)


def test_sse_framing(spark):
    text = ": hello\r\n\r\nevent: x\ndata: {\"type\": \"delta\",\ndata:  \"delta\": \"a\", \"index\": 1}\n\n\n\ndata: [DONE]\n\ndata: {\"type\": \"late\"}"
    got = sse.parse_sse(spark.createDataFrame([(1, text), (2, "")], "s long, capture string"), "s").collect()
    assert [(r.s, r.position, r.type, r.delta, r["index"]) for r in got] == [(1, 0, "delta", "a", 1)]


def test_a_long_capture_is_read_in_splits(spark, tmp_path):
    rng = random.Random(4)
    ends = ["\n", "\r\n"]
    for name in ("a", "b"):
        end = ends[name == "b"]
        parts = [": hello" + end + end]
        for i in range(3000):
            parts.append("".join(["event: x" + end] * rng.randrange(2)) + f'data: {{"type": "delta",{end}data:  "delta": "{"é" * rng.randrange(30)}{i}", "index": {i}}}{end}{end}' + end * rng.randrange(2))
        parts.append(f'data: [DONE]{end}{end}data: {{"type": "late"}}{end}')
        (tmp_path / f"{name}.txt").write_bytes("".join(parts).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sse.read_sse_events(spark, f"file://{tmp_path}")
        lines = spark.read.text(f"file://{tmp_path}")
        assert lines.rdd.getNumPartitions() > 10
        rows = [(r.capture.rsplit("/", 1)[1], r.position, r.type, r["index"], r.delta.lstrip("é")) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == sorted((f"{n}.txt", i, "delta", i, str(i)) for n in "ab" for i in range(3000))


def test_event_text(spark):
    row = spark.createDataFrame([('say "hi"\n é',)], "d string")
    got = row.select(sse.delta_event(F.col("d"), F.lit(3)).alias("e")).first().e
    assert got == 'data: {"type": "delta", "delta": "say \\"hi\\"\\n é", "index": 3}\n\n'


def test_reassemble(spark):
    rows = [(1, 2, "delta", "b", None), (1, 1, "delta", "a", None), (1, 3, "done", None, None), (2, 1, "delta", "x", None), (3, 1, "error", None, "gone")]
    df = spark.createDataFrame(rows, "stream_id long, index long, type string, delta string, message string")
    got = {r.stream_id: (r.answer, r.error) for r in W.reassemble(df).collect()}
    assert got == {1: ("ab", None), 2: ("x", "stream closed before done event"), 3: ("", "gone")}


def test_charsets(spark):
    cases = ["plain", "中文", "﻿bom", "é"]
    raw = [c.encode("utf-8") for c in cases] + ["中文文本".encode("gbk"), "𠀀中".encode("gb18030"), b"", b"ab\xff"]
    rows = spark.createDataFrame(list(enumerate(bytearray(r) for r in raw)), "i long, content binary")
    got = [r.text for r in D.decode_text(rows).orderBy("i").collect()]
    assert got == [*cases, "中文文本", "𠀀中", "", "ab"]


def test_table_rows(spark):
    df = spark.createDataFrame([([" a ", "", "b\n"],)], "cells array<string>")
    assert df.select(D.table_row_text(F.col("cells"))).first()[0] == "a | b"


def test_uploads_and_mapping(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.md").write_text("hello", encoding="utf-8")
    (tmp_path / "up" / "b.exe").write_text("no", encoding="utf-8")
    found = files.read_files(spark, str(tmp_path / "up")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.size_bytes, bytes(r.content)) for r in found] == [("a.md", 5, b"hello")]
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "m.json").write_text('[{"row_id": 0, "chunk_id": 7, "doc_id": 11, "chunk_index": 0, "content": "x"}]', encoding="utf-8")
    assert files.read_index_mapping_json(spark, str(tmp_path / "map")).first() == (0, 7, 11, 0, "x")


def test_database_parts_hold_every_row_once(spark):
    rng = random.Random(6)
    rows = [(int(rng.paretovariate(1.0)) if i % 40 else None, "".join(rng.choice("ab'c") for _ in range(6))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, name string").withColumn("at", F.timestamp_seconds(F.col("id") * 7))
    df.createOrReplaceTempView("numbered")
    for key in ("id", "name", "at"):
        predicates = files.key_predicates(key, files.key_bounds(df, key, 8))
        counts = [spark.sql(f"SELECT * FROM numbered WHERE {p}").count() for p in predicates]
        assert sum(counts) == 4000 and len(counts) > 3
        if key == "name":
            assert max(counts) < 2 * 4000 / 8
    assert files.key_predicates("id", []) == ["1 = 1"] and files.key_bounds(df.limit(0), "id", 4) == []
    assert files.key_predicates("k", ["a'b"]) == ["k < 'a''b' OR k IS NULL", "k >= 'a''b'"]


def test_filter_reaches_the_scan(spark):
    from conftest import SF_DIR

    df = files.read_table(spark, f"{SF_DIR}/orders.parquet", ["o_orderkey"], F.col("o_totalprice") > 400000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000" in plan and "o_orderpriority" not in plan


def test_latest_non_null(spark):
    rows = [(1, 1, "STARTED", 5, None), (1, 2, None, 20, None), (1, 3, "SUCCESS", None, None), (2, 1, "FAILURE", 40, "boom"), (2, 2, None, None, None)]
    df = spark.createDataFrame(rows, "task_id long, seq long, state string, progress int, error string")
    assert {tuple(r) for r in K.latest_task_state(df).collect()} == {(1, "SUCCESS", 20, None), (2, "FAILURE", 40, "boom")}
    assert {tuple(r) for r in ST.task_state(df).collect()} == {(1, "SUCCESS", 100, None), (2, "FAILURE", 100, "boom")}


def test_citations_of_a_hot_message_stay_whole_and_in_order(spark):
    cites = spark.range(5000).select(
        F.col("id"), F.lit(1).cast("long").alias("message_id"), F.lit(2).cast("long").alias("doc_id"), F.col("id").alias("chunk_id"),
        F.col("id").cast("int").alias("chunk_index"), (F.col("id") % 10 / 10).alias("score"), F.lit(None).cast("string").alias("snippet"),
    )
    m = spark.createDataFrame([(1,), (2,)], "message_id long")
    want = sorted(range(5000), key=lambda i: (-(i % 10), i))
    got = {r.message_id: [c.citation_id for c in r.citations] for r in C.messages_with_citations(m, cites).collect()}
    assert got == {1: want, 2: []}
    flat = sorted((r.position, r.id) for r in C.message_citations_flat(m, cites).collect())
    assert flat == [(i + 1, x) for i, x in enumerate(want)]


def test_empty_summaries(spark):
    schema = "id long, request_type string, status string, prompt_tokens int, completion_tokens int, cost_usd decimal(16,8), timed_out boolean, no_context boolean"
    none = spark.createDataFrame([], schema)
    assert tuple(M.error_timeout_rates(none).first()) == (0, None, None)
    assert M.no_context_ratio(none).first()[0] is None
    assert tuple(M.token_cost_totals(none).first()) == (None, 0, None, 0, None, None, 0.0, 0.0)
    assert M.latency_summary(spark.createDataFrame([], "metric string, id long, value double")).count() == 0


def test_concurrency(spark):
    rows = [(1, False, 0, 10), (1, True, 5, 20), (2, True, 8, 9), (3, False, 20, 30)]
    df = spark.createDataFrame(rows, "session_id long, is_stream boolean, a long, b long").select(
        "session_id", "is_stream", F.timestamp_seconds(F.col("a") * 3000).alias("started_at"), F.timestamp_seconds(F.col("b") * 3000).alias("ended_at")
    )
    got = {int(r.ts.timestamp()) // 3000: (r.sessions, r.streams) for r in M.concurrency_by_instant(df).collect()}
    assert got == {0: (1, 0), 5: (1, 1), 8: (2, 2), 9: (1, 1), 10: (1, 1), 20: (1, 0), 30: (0, 0)}


def test_suffixes_in_any_case_are_read(spark, tmp_path):
    from chunkloom.sources import files

    for name in ("a.txt", "b.TXT", "c.Md", "d.json", "e.exe", "f.Docx"):
        (tmp_path / name).write_text(name)
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {n: n for n in ("a.txt", "b.TXT", "c.Md", "d.json", "f.Docx")}


def test_a_second_ingest_reads_only_what_is_new(spark, tmp_path):
    from chunkloom.streaming import ingest as I

    path, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "doc_id long, version int, text string"
    run = lambda: I.run_incremental_ingest(spark.readStream.schema(schema).parquet(path), out, state)
    spark.createDataFrame([(1, 1, "one two"), (2, 1, "three")], schema).write.parquet(path)
    run()
    spark.createDataFrame([(1, 2, "new")], schema).write.mode("append").parquet(path)
    current, index = run()
    assert {(r.doc_id, r.version, r.content) for r in current.collect()} == {(1, 2, "new"), (2, 1, "three")}
    assert {(r.doc_id, r.chunk_count) for r in index.collect()} == {(1, 1), (2, 1)}
    batches = spark.read.parquet(f"{out}/documents").groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in batches) == [(0, 2), (1, 1)]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    from chunkloom.streaming import ingest as I

    path, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "doc_id long, version int, text string"
    run = lambda: I.run_incremental_ingest(spark.readStream.schema(schema).parquet(path), out, state, buckets=8)
    spark.createDataFrame([(i, 1, f"text {i}") for i in range(100)], schema).write.parquet(path)
    run()
    before = I.current_folders(spark, out)
    assert set(before) == set(range(8)) and {b for b, _ in before.values()} == {0}
    spark.createDataFrame([(3, 2, ""), (3, 1, "older"), (200, 1, "new")], schema).write.mode("append").parquet(path)
    current, index = run()
    after = I.current_folders(spark, out)
    changed = {b for b, (batch, _) in after.items() if batch == 1}
    assert 1 <= len(changed) <= 2 and sorted(d.name for d in (tmp_path / "out" / "current" / "batch=1").glob("bucket=*")) == sorted(f"bucket={b}" for b in changed)
    assert all(f"/batch={after[b][0]}/bucket={b}/" in f for f in current.inputFiles() for b in [int(re.search(r"bucket=(\d+)", f)[1])])
    assert {(r.doc_id, r.content) for r in current.collect()} == {(i, f"text {i}") for i in range(100) if i != 3} | {(200, "new")}
    assert {r.doc_id: (r.version, r.chunk_count) for r in index.where("doc_id in (3, 4, 200)").collect()} == {3: (2, 0), 4: (1, 1), 200: (1, 1)}


def test_answers_that_look_like_lists_stay_text(spark):
    from chunkloom.functions import records as R

    said = ['"[1] According to"', '"[Chunk 1] yes"', '"[\\"a\\"]"', '"{x"', '[{"type": "text", "text": "a"}, {"type": "image", "text": "no"}, "{b", null, 3]', "7", "null"]
    rows = [(i, '{"choices": [{"message": {"content": %s}}]}' % c) for i, c in enumerate(said)] + [(7, '{"choices": []}'), (8, "broken")]
    got = {r.i: (r.r.answer, r.r.error) for r in spark.createDataFrame(rows, "i int, j string").select("i", R.extract_answer(F.col("j")).alias("r")).collect()}
    missing = "llm response missing "
    assert [got[i][0] for i in range(9)] == ["[1] According to", "[Chunk 1] yes", '["a"]', "{x", "a{b3", "7", None, None, None]
    assert got[6][1] == missing + "answer content" and got[7][1] == got[8][1] == missing + "choices"


def conversations_of(spark, folder, ids):
    import duckdb

    rows = [(i, t, r, f"{r} {i} " + "said so " * (i % 40)) for i in ids for t, r in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


def test_answers_years_apart_pass_the_think_filter(spark, tmp_path):
    from compare import compare
    from chunkloom.plans import catalog

    catalog.load()
    con = conversations_of(spark, tmp_path, range(0, 200_000, 2_000))
    assert compare(spark, con, "", catalog.QUERIES["stream_think_filter"], catalog.ORACLE["stream_think_filter"], str(tmp_path))[0] == []


def test_files_of_a_capture_follow_one_another(spark, tmp_path):
    folder = tmp_path / "capture=7"
    folder.mkdir()
    for i in range(12):
        # A frame may begin in one file and end in the next.
        (folder / f"part-{i:03}.txt").write_text(f'data:  "index": {i}}}\n\ndata: {{"type": "delta",\n' if i else 'data: {"type": "delta",\n')
    got = sse.read_sse_events(spark, f"file://{tmp_path}", F.regexp_extract("_metadata.file_path", r"capture=(\d+)", 1).cast("long"))
    assert sorted((r.capture, r.position, r["index"]) for r in got.where("type is not null").collect()) == [(7, i - 1, i) for i in range(1, 12)]


def test_long_captures_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from compare import compare
    from chunkloom.plans import catalog, stream_queries

    catalog.load()
    monkeypatch.setattr(stream_queries, "CAPTURE_EVENTS", 100)
    con = conversations_of(spark, tmp_path, range(100))
    assert compare(spark, con, "", catalog.QUERIES["read_sse_files"], catalog.ORACLE["read_sse_files"], str(tmp_path))[0] == []


def test_embedded_chunks_move_only_to_their_buckets(spark):
    from chunkloom.streaming import ingest as I

    rows = [(1, 1, "old"), (1, 2, "one two"), (2, 1, None), (None, 1, "nobody's"), (3, 5, "three")]
    batch = I.ingest_batch(spark.createDataFrame(rows, "doc_id long, version int, text string"))
    assert "Join" not in batch._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.version, r.content, r.chunk_id, len(r.embedding)) for r in batch.collect()} == {(1, 2, "one two", 1_000_000, 64), (3, 5, "three", 3_000_000, 64)}


def test_uploads_lie_in_many_folders(spark, con, monkeypatch):
    from compare import compare
    from conftest import SF_DIR
    from chunkloom.plans import catalog, corpus_queries

    catalog.load()
    path = []
    monkeypatch.setattr(corpus_queries, "FOLDER_FILES", 10)
    monkeypatch.setattr(corpus_queries, "scratch_path", lambda s, n, real=corpus_queries.scratch_path: path.append(real(s, n)) or path[-1])
    assert compare(spark, con, "", catalog.QUERIES["scan_document_files"], catalog.ORACLE["scan_document_files"], SF_DIR)[0] == []
    folders = files.read_files(spark, path[0]).select(F.regexp_extract("path", r"folder=(\d+)", 1)).distinct().count()
    assert folders > 10


def _odd_documents(spark, tmp_path):
    """A copy of the tables whose documents have odd languages, missing texts, repeated and missing ids."""
    from conftest import SF_DIR
    from compare import TABLES, duck

    sf = tmp_path / "sf"
    sf.mkdir()
    for name in TABLES:
        if name != "documents":
            (sf / f"{name}.parquet").symlink_to(f"{SF_DIR}/{name}.parquet")
    langs = [None, "", "null", "none", "-en", "e/n", "lang=en", "a b+c%20", "*~!", "中文", "..", "__HIVE_DEFAULT_PARTITION__", "EN", "en"]
    rows = [(None if i % 9 == 0 else i // 2, lang, text) for i, (lang, text) in enumerate((a, b) for a in langs for b in (None, "", "x", "x", "a\nb\r\n", "\n", "é中𠀀"))]
    rows += [(10_000 + i, "no text", None) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    (sf / "documents.parquet").symlink_to(next((tmp_path / "docs").glob("part-*.parquet")))
    return str(sf), duck(str(sf))


def test_uploads_of_odd_documents(spark, tmp_path, monkeypatch):
    from compare import compare
    from chunkloom.plans import catalog, corpus_queries
    from chunkloom.sources import sinks

    catalog.load()
    sf, con = _odd_documents(spark, tmp_path)
    query, sql = catalog.QUERIES["scan_document_files"], catalog.ORACLE["scan_document_files"]
    monkeypatch.setattr(corpus_queries, "FOLDER_FILES", 3)
    assert compare(spark, con, "", query, sql, sf)[0] == []
    monkeypatch.setattr(files, "FOLDERS_AT_ONCE", 5)
    assert compare(spark, con, "", query, sql, sf)[0] == []
    # As in a store that only Spark writes to.
    monkeypatch.setattr(sinks, "local_folder", lambda *_: None)
    assert compare(spark, con, "", query, sql, sf)[0] == []


def test_no_documents_no_uploads(spark, monkeypatch):
    from chunkloom.plans import adapters, catalog
    from chunkloom.sources import sinks

    catalog.load()
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    monkeypatch.setattr(adapters, "table", lambda *_: none)
    assert catalog.QUERIES["scan_document_files"](spark, "").collect() == []
    monkeypatch.setattr(sinks, "local_folder", lambda *_: None)
    assert catalog.QUERIES["scan_document_files"](spark, "").collect() == []


def test_an_upload_takes_no_program(spark, monkeypatch):
    from pathlib import Path
    from conftest import SF_DIR
    from chunkloom.plans import catalog, corpus_queries

    catalog.load()
    path = []
    monkeypatch.setattr(corpus_queries, "scratch_path", lambda s, n, real=corpus_queries.scratch_path: path.append(real(s, n)) or path[-1])
    documents = sum(r.files for r in catalog.QUERIES["scan_document_files"](spark, SF_DIR).collect())
    # Hadoop's local file system starts a program for the rights of each file and one for its checksum; a file by a task has no checksum.
    assert len([f for f in Path(path[0].removeprefix("file:")).rglob("*") if f.is_file()]) == documents == 200


def test_the_driver_knows_few_uploads(spark, tmp_path, monkeypatch):
    from chunkloom.sources import sinks

    rows = spark.range(0, 2000, 1, 4).select(F.concat(F.lit("-"), F.col("id") % 3).alias("label"), F.col("id").cast("string").alias("text"))
    path = str(tmp_path / "up")
    folders = sinks.write_files(rows, path, 100)
    assert len(folders) == 20 and all(len([f for f in (tmp_path / "up").glob(f"{x[len(path) + 1:]}/*/*")]) == 100 for x in folders)
    monkeypatch.setattr(files, "FOLDERS_AT_ONCE", 3)
    groups = list(files.read_folders(spark, path, folders))
    assert max(len(g.inputFiles()) for g in groups) == 300
    got = [(r.path.rsplit("/", 2)[1], bytes(r.content), r.size_bytes) for g in groups for r in g.collect()]
    assert sorted(got) == sorted((f"label=-{i % 3}", f"{i}\n".encode(), len(str(i)) + 1) for i in range(2000))


def test_a_second_attempt_leaves_the_files_of_the_first(tmp_path, monkeypatch):
    import pyarrow as pa
    from chunkloom.sources import sinks

    monkeypatch.setattr(sinks.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 4})())

    def attempt(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(["-x"] * len(texts)), pa.array(texts, pa.binary())], ["label", "text"])
        return [f for b in sinks._one_file_each(str(tmp_path), 2)([batch]) for f in b.column("folder").to_pylist()]

    first = attempt([b"a", b"b", b"c"])
    assert sorted(attempt([b"c", b"b", b"a"])) == sorted(first) == ["task=4/folder=4000000", "task=4/folder=4000001"]
    assert [f.read_bytes() for f in sorted(tmp_path.glob("task=4/*/*/*"))] == [b"a\n", b"b\n", b"c\n"]
    assert attempt([]) == []


def test_frames_of_earlier_folders_are_let_go(spark, tmp_path):
    import gc
    import weakref
    from chunkloom.sources import sinks

    folders = sinks.write_files(spark.range(60).select(F.lit("-").alias("label"), F.col("id").cast("string").alias("text")), str(tmp_path / "up"), 1)
    held, alive = [], []
    gc.collect()
    gc.disable()
    try:
        for found in files.read_folders(spark, str(tmp_path / "up"), folders):
            alive += [r() is not None for r in held]
            counted = found.groupBy("path").agg(F.count("*").alias("n"))
            counted.write.parquet(str(tmp_path / f"counted-{len(held)}"))
            held.append(weakref.ref(counted._jdf))
            del counted
    finally:
        gc.enable()
    assert len(held) == 2 and alive == [False]
