"""Files, documents, chunks and text functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as Y

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T
from chunkloom.operators import chunks as C, documents as D
from chunkloom.operators.ranking import one_row
from chunkloom.operators.tasks import in_views
from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query
from chunkloom.session import scratch_path, written
from chunkloom.sources import files, sinks


#: Uploaded files of one folder, over all languages.
FOLDER_FILES = 1000
#: Begins the labels of documents without a text; no label of a language begins so.
NO_TEXT = "none"


@query("""SELECT lang, count(*) AS files, sum(strlen(text) + 1)::BIGINT AS total_bytes, sum(strlen(text) + 1)::BIGINT AS read_bytes,
    bit_xor(('0x' || substring(md5(text || chr(10)), 1, 15))::BIGINT) AS contents FROM documents GROUP BY lang""")
def scan_document_files(spark, sf):
    """One file per document, whose bytes are told apart by their digests.

    Files are counted some folders at a time. A document without a text is a file too, and none of its bytes count.
    """
    path, counted = scratch_path(spark, "uploads"), scratch_path(spark, "scanned")
    docs = files.spread(A.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    label = F.concat(F.when(F.col("text").isNull(), NO_TEXT).otherwise(""), sinks.as_label(F.col("lang")))
    folders = sinks.write_files(docs.select(label.alias("label"), "text"), path, FOLDER_FILES)
    label = F.regexp_extract("path", "/label=([^/]*)/[^/]*$", 1)
    digest = F.conv(F.substring(F.md5("content"), 1, 15), 16, 10).cast("long")
    for found in files.read_folders(spark, path, folders):
        found.groupBy(label.alias("label")).agg(
            F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"), F.sum(F.octet_length("content")).cast("long").alias("read_bytes"),
            F.bit_xor(digest).alias("contents"),
        ).write.mode("append").parquet(counted)
    found = spark.read.schema("label string, files long, total_bytes long, read_bytes long, contents long").parquet(counted)
    lang = sinks.from_label(F.regexp_replace("label", f"^{NO_TEXT}", ""))
    held = {c: F.when(~F.col("label").startswith(NO_TEXT), F.col(c)) for c in ("total_bytes", "read_bytes", "contents")}
    return found.select(lang.alias("lang"), "files", *[v.alias(c) for c, v in held.items()]).groupBy("lang").agg(
        F.sum("files").alias("files"), F.sum("total_bytes").alias("total_bytes"), F.sum("read_bytes").alias("read_bytes"),
        F.bit_xor("contents").alias("contents"),
    )


_GATE = "CASE WHEN extension NOT IN ('md','txt','json','csv','pdf','docx') THEN 'unsupported file type' END"


@query(O.using("corpus", body=f"""SELECT id, filename, extension, {_GATE} AS reject_reason
  FROM (SELECT *, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS extension FROM corpus)"""))
def gate_extension(spark, sf):
    return D.gate_extension(A.corpus_documents(spark, sf)).select("id", "filename", "extension", "reject_reason")


@query(O.using("corpus", body="""SELECT id, size_bytes, CASE WHEN size_bytes <= 0 THEN 'empty file'
  WHEN size_bytes > 4000 THEN 'file too large' END AS reject_reason FROM corpus"""))
def gate_size(spark, sf):
    return D.gate_size(A.corpus_documents(spark, sf), max_bytes=4000).select("id", "size_bytes", "reject_reason")


@query(O.using("corpus", body="""SELECT id, user_id, clean AS clean_name, CASE ext WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain'
    WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv' WHEN 'pdf' THEN 'application/pdf'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime,
    sha256, size_bytes, user_id || '_' || substring(sha256, 1, 16) || '_' || id || regexp_extract(clean, '(\\.[^.]*)$', 1) AS stored_name
  FROM (SELECT *, replace(filename, ':', '_') AS clean, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS ext FROM corpus)"""))
def document_metadata(spark, sf):
    docs = A.corpus_documents(spark, sf).withColumn("content", F.encode("text", "UTF-8"))
    return D.document_metadata(docs, F.col("id").cast("string"))


@query("SELECT doc_id, text FROM documents")
def decode_text(spark, sf):
    """A quarter of the documents is stored as GB18030; all must come back as they were."""

    @F.pandas_udf("binary")
    def as_gb18030(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: None if text is None else text.encode("gb18030"))

    legacy = F.col("doc_id") % 4 == 1
    raw = F.when(legacy, as_gb18030(F.when(legacy, F.col("text")))).otherwise(F.encode("text", "UTF-8"))
    stored = A.texts(spark, sf).select("doc_id", raw.alias("content"))
    return D.decode_text(stored).select("doc_id", "text")


@query(f"""SELECT conv_id AS doc_id, string_agg('[Page ' || (turn + 1) || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY turn) AS text
  FROM (SELECT conv_id, turn, {O.strip('text')} AS body FROM conversations) WHERE body <> '' GROUP BY conv_id""")
def assemble_page_text(spark, sf):
    pages = A.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text"
    )
    return D.assemble_page_text(pages)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def read_relational_table(spark, sf):
    keep = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return files.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], keep)


@query(O.using("messages", body="""SELECT message_id, role, updated_at, NULL::VARCHAR AS meta_json FROM messages WHERE session_id % 2 = 0
  UNION ALL SELECT message_id, role, NULL, NULL FROM messages WHERE session_id % 2 = 1"""))
def schema_tolerant_scan(spark, sf):
    wanted = Y.StructType(
        [
            Y.StructField("message_id", Y.LongType()),
            Y.StructField("role", Y.StringType()),
            Y.StructField("updated_at", Y.TimestampType()),
            Y.StructField("meta_json", Y.StringType()),
        ]
    )
    m = A.messages(spark, sf)
    old_shape = m.where(F.col("session_id") % 2 == 1).drop("updated_at")
    new_shape = m.where(F.col("session_id") % 2 == 0)
    return files.schema_tolerant(new_shape, wanted).unionByName(files.schema_tolerant(old_shape, wanted))


_REPLACED = """SELECT doc_id, chunk_index, content, tokens_est FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 0, 'replaced ' || quality, 2 FROM labels"""


def _replacement(spark, sf):
    return A.table(spark, sf, "labels").select(
        "doc_id",
        F.lit(0).alias("chunk_index"),
        F.concat(F.lit("replaced "), F.col("quality").cast("string")).alias("content"),
        F.lit(2).alias("tokens_est"),
    )


@query(O.using("chunks", body=_REPLACED))
def write_chunks(spark, sf):
    first = written(C.chunk_documents(A.texts(spark, sf)), "chunks-first")
    path = scratch_path(spark, "chunks")
    sinks.write_chunks(first, path)
    sinks.write_chunks(_replacement(spark, sf), path, old=first)
    return spark.read.parquet(path).select("doc_id", "chunk_index", "content", "tokens_est")


@query(O.using("vectors", body="SELECT doc_id, count(*) AS chunk_count, max(len(embedding))::INTEGER AS dimension FROM vectors GROUP BY doc_id"))
def write_vector_index(spark, sf):
    rows = A.vectors(spark, sf).join(A.vector_contents(spark, sf), "chunk_id")
    return sinks.write_vector_index(rows, scratch_path(spark, "index"))


@query(O.using("vectors", "contents", body="""SELECT (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INTEGER AS row_id,
  chunk_id, doc_id, chunk_index, content FROM vectors JOIN contents USING (chunk_id)"""))
def read_index_mapping_json(spark, sf):
    rows = C.index_row_id(A.vectors(spark, sf).drop("embedding")).join(A.vector_contents(spark, sf), "chunk_id")
    item = F.struct("row_id", "chunk_id", "doc_id", "chunk_index", "content")
    path = scratch_path(spark, "mapping")
    # One mapping file per document, as the format has it; the files lie in a fixed number of folders.
    per_doc = sinks.with_bucket(rows.groupBy("doc_id").agg(F.to_json(F.collect_list(item)).alias("value"))).drop("doc_id")
    per_doc.write.partitionBy("doc_bucket").option("maxRecordsPerFile", 1).text(path)
    return files.read_index_mapping_json(spark, path).select("row_id", "chunk_id", "doc_id", "chunk_index", "content")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_by_id(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return D.filter_by_id(docs, A.table(spark, sf, "labels"), "doc_id")


@query(O.using("corpus", body="""SELECT 'ready' AS view, id, status FROM corpus WHERE status = 'READY'
  UNION ALL SELECT 'processing', id, status FROM corpus WHERE status IN ('PROCESSING', 'UPLOADED')
  UNION ALL SELECT 'failed', id, status FROM corpus WHERE status = 'FAILED'"""))
def filter_documents(spark, sf):
    docs = A.corpus_documents(spark, sf).select("id", "status")
    views = {v: c for v, c in D.document_views().items() if v != "all"}
    return in_views(docs, views).select("view", "id", "status")


@query(O.using("corpus", "latest_tasks", body="""SELECT id, CASE WHEN t.task_id IS NULL THEN status WHEN t.state = 'SUCCESS' THEN 'READY'
    WHEN t.state = 'FAILURE' THEN 'FAILED' ELSE 'PROCESSING' END AS status, progress,
    CASE WHEN t.progress > 10 THEN t.progress ELSE (id % 9)::INTEGER END AS chunks,
    coalesce(t.state = 'SUCCESS', false) AS vectorized, error
  FROM corpus LEFT JOIN (SELECT task_id, coalesce(state, 'PENDING') AS state, progress, error FROM latest_tasks) t ON t.task_id = id"""))
def document_status_from_task(spark, sf):
    from chunkloom.operators.tasks import latest_task_state

    latest = latest_task_state(A.task_updates(spark, sf)).select(
        F.col("task_id").alias("doc_id"),
        F.coalesce("state", F.lit("PENDING")).alias("state"),
        "progress",
        F.when(F.col("progress") > 10, F.col("progress")).alias("chunk_count"),
        "error",
    )
    docs = A.corpus_documents(spark, sf).select("id", "status", (F.col("id") % 9).cast("int").alias("chunks"))
    return D.document_status_from_task(docs, latest)


@query(O.using("corpus", "chunks", body="""SELECT id, any_value(status) AS status, count(chunk_index) AS chunk_count
  FROM corpus LEFT JOIN chunks ON doc_id = id GROUP BY id"""))
def documents_left_join_chunks(spark, sf):
    return D.documents_left_join_chunks(A.corpus_documents(spark, sf), A.chunks(spark, sf))


@query(O.using("corpus", "chunks", body="""SELECT chunk_id, doc_id, status IS NULL AS orphan
  FROM chunks LEFT JOIN (SELECT * FROM corpus WHERE status <> 'FAILED') ON doc_id = id"""))
def orphan_rows_anti_join(spark, sf):
    rows = A.chunks(spark, sf).select("chunk_id", "doc_id")
    parents = A.corpus_documents(spark, sf).where(F.col("status") != "FAILED")
    rows = written(rows, "chunk-ids")  # read by both sides: chunked once
    gone = D.orphans(rows, parents, "doc_id", "id").withColumn("orphan", F.lit(True))
    kept = D.keep_linked(rows, parents, "doc_id", "id").withColumn("orphan", F.lit(False))
    return gone.unionByName(kept).select("chunk_id", "doc_id", "orphan")


@query(O.using("chunks", body=_REPLACED))
def replace_document_chunks(spark, sf):
    old = A.chunks(spark, sf).select("doc_id", "chunk_index", "content", "tokens_est")
    return C.replace_document_chunks(old, _replacement(spark, sf))


@query(O.using("vectors", body="""SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.chunk_count, a.chunk_count) AS chunk_count,
    CASE WHEN b.doc_id IS NULL THEN 1 ELSE 2 END AS version
  FROM (SELECT doc_id, count(*) AS chunk_count FROM vectors GROUP BY doc_id) a
  FULL JOIN (SELECT doc_id + 3 AS doc_id, count(*) * 2 AS chunk_count FROM vectors GROUP BY ALL) b USING (doc_id)"""))
def upsert_document_index(spark, sf):
    counts = A.vectors(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    current = counts.withColumn("version", F.lit(1))
    incoming = counts.select(
        (F.col("doc_id") + 3).alias("doc_id"), (F.col("chunk_count") * 2).alias("chunk_count"), F.lit(2).alias("version")
    )
    return C.upsert_latest(current, incoming, "doc_id", "version")


@query(O.using("corpus", body="""SELECT id, user_id, sha256, CASE WHEN first_id < id THEN first_id END AS duplicate_of,
    CASE WHEN first_id < id THEN 409 ELSE 200 END AS status_code
  FROM (SELECT id, id % 2 AS user_id, sha256, min(id) OVER (PARTITION BY id % 2, sha256) AS first_id FROM corpus)"""))
def duplicate_upload(spark, sf):
    docs = A.corpus_documents(spark, sf).select("id", (F.col("id") % 2).alias("user_id"), "sha256")
    return D.duplicate_upload(docs).select("id", "user_id", "sha256", "duplicate_of", "status_code")


@query(O.using("corpus", "chunks", body="""SELECT (SELECT count(*) FROM corpus WHERE status = 'READY') AS documents_ready,
    (SELECT count(*) FROM chunks) AS total_chunks,
    (SELECT sum((status = 'READY')::INTEGER)::BIGINT FROM corpus LEFT JOIN chunks ON doc_id = id) AS ready_by_fanout"""))
def corpus_counts(spark, sf):
    docs, chunks = A.corpus_documents(spark, sf), A.chunks(spark, sf)
    plain = D.corpus_counts(docs, chunks)
    fanout = D.corpus_counts(docs, chunks, fanout_compatible=True)
    return one_row(plain, fanout.select(F.col("documents_ready").alias("ready_by_fanout")))


@query(O.using("chunks", body="""SELECT doc_id, sum(tokens_est)::BIGINT AS embedding_tokens, round(sum(tokens_est) * 0.02 / 1000.0, 8) AS cost_usd
  FROM chunks GROUP BY doc_id"""))
def embedding_tokens_per_doc(spark, sf):
    return C.embedding_tokens_per_doc(A.chunks(spark, sf), 0.02)


@query(O.using("corpus", "tasks", body="""SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'READY') AS ready,
    count(*) FILTER (WHERE status IN ('PROCESSING', 'UPLOADED')) AS processing, count(*) FILTER (WHERE status = 'FAILED') AS failed,
    sum(id % 9) FILTER (WHERE status = 'READY' AND id % 5 > 0)::BIGINT AS known_chunks FROM corpus),
  (SELECT count(*) AS total_tasks, count(*) FILTER (WHERE state NOT IN ('SUCCESS', 'FAILURE', 'FAILED')) AS running_tasks,
    count(*) FILTER (WHERE state IN ('FAILURE', 'FAILED')) AS failed_tasks, count(*) FILTER (WHERE state = 'SUCCESS') AS success_tasks FROM tasks)"""))
def document_dashboard(spark, sf):
    from chunkloom.operators.tasks import task_totals

    docs = A.corpus_documents(spark, sf).withColumn("chunks", F.when(F.col("id") % 5 > 0, F.col("id") % 9))
    return one_row(D.document_dashboard(docs), task_totals(A.tasks(spark, sf)))


@query(f"""SELECT doc_id, n AS chunk_count, n * 2048 AS vector_bytes, n * 4096 AS disk_low_bytes, n * 10240 AS disk_high_bytes, n * 512 AS multiply_adds
  FROM (SELECT doc_id, {O.windows('length(text)')} AS n FROM documents)""")
def capacity_estimate(spark, sf):
    return C.capacity_estimate(A.texts(spark, sf))


@query(O.using("chunks", body="SELECT doc_id, chunk_index, content FROM chunks"))
def chunk_index_assign(spark, sf):
    windows = A.texts(spark, sf).select("doc_id", T.normalize_document_text(F.col("text")).alias("t"))
    starts = F.sequence(F.lit(0).cast("long"), T.window_count(F.char_length("t")) - 1)
    step = K.CHUNK_SIZE - K.CHUNK_OVERLAP
    pieces = windows.where(F.char_length("t") > 0).select("doc_id", "t", F.explode(starts).alias("pos")).select(
        "doc_id", "pos", T.strip(F.substring(F.col("t"), (F.col("pos") * step + 1).cast("int"), F.lit(K.CHUNK_SIZE))).alias("text")
    )
    return C.chunk_index_assign(pieces).select("doc_id", "chunk_index", F.col("text").alias("content"))


@query(O.using("vectors", body="""SELECT chunk_id, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INTEGER AS row_id
  FROM vectors"""))
def index_row_id(spark, sf):
    """Gaps in the chunk index must not show in the row id."""
    present = A.vectors(spark, sf).withColumn("chunk_index", F.col("chunk_index") * 3).drop("embedding")
    return C.index_row_id(present).select("chunk_id", "doc_id", "row_id")


@query(O.using("chunks", body="SELECT doc_id, chunk_index, tokens_est, content FROM chunks WHERE chunk_index < 200"))
def list_chunks(spark, sf):
    return C.list_chunks(A.chunks(spark, sf).select("doc_id", "chunk_index", "tokens_est", "content"))


@query(O.using("normal_docs", body="SELECT doc_id, t AS text FROM normal_docs"))
def normalize_document_text(spark, sf):
    return A.texts(spark, sf).select("doc_id", T.normalize_document_text(F.col("text")).alias("text"))


@query(O.using("chunks", body="SELECT chunk_id, doc_id, chunk_index, content, tokens_est FROM chunks"))
def chunk_documents(spark, sf):
    return A.chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index", "content", "tokens_est")


@query(f"SELECT doc_id, {O.tokens('text')} AS tokens, {O.tokens('source')} AS source_tokens FROM documents")
def estimate_tokens(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.estimate_tokens(F.col("source")).alias("source_tokens"))


_FLAT = O.strip(f"regexp_replace(text, '{O.WS}+', ' ', 'g')")


@query(f"SELECT doc_id, {_FLAT} AS plain, 'query:' || chr(10) || {_FLAT} AS prefixed FROM documents")
def collapse_whitespace_prefix(spark, sf):
    body = F.col("text")
    return A.texts(spark, sf).select("doc_id", T.prefixed("", body).alias("plain"), T.prefixed("query:\\n", body).alias("prefixed"))


@query("""SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9\\-_.@]', '_', 'g') AS identity,
    sha256(c_name) AS key_hash, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE 'x_y' END AS blank_case FROM customer""")
def anonymize_identity(spark, sf):
    c = A.table(spark, sf, "customer")
    blank = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.lit("x y"))
    return c.select(
        "c_custkey",
        R.sanitize_identity(F.col("c_name")).alias("identity"),
        F.sha2("c_name", 256).alias("key_hash"),
        R.sanitize_identity(blank).alias("blank_case"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'peer' WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id
    WHEN event_id % 5 = 0 THEN 'real-' || user_id ELSE 'peer' END AS ip FROM events""")
def client_ip(spark, sf):
    e = A.table(spark, sf, "events")
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    forwarded = F.when(i % 3 == 0, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 9.9.9.9"))).when(i % 7 == 0, F.lit(" ,1.1.1.1"))
    real = F.when(i % 5 == 0, F.concat(F.lit("real-"), user))
    return e.select("event_id", R.client_ip(forwarded, real, F.lit("peer"), i % 2 == 1).alias("ip"))
