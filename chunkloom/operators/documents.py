"""Uploaded documents: gates, metadata, text decoding, duplicates and integrity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.functions import records as R, text as T


def gate_extension(files: DataFrame, name: str = "filename") -> DataFrame:
    ext = R.file_extension(F.col(name))
    ok = ext.isin(*K.SUPPORTED_EXTENSIONS)
    return files.withColumn("extension", ext).withColumn(
        "reject_reason", F.when(~ok, F.lit("unsupported file type"))
    )


def gate_size(files: DataFrame, size: str = "size_bytes", max_bytes: int = K.MAX_DOCUMENT_BYTES) -> DataFrame:
    n = F.col(size)
    reason = F.when(n <= 0, F.lit("empty file")).when(n > max_bytes, F.lit("file too large"))
    return files.withColumn("reject_reason", reason)


def document_metadata(files: DataFrame, suffix: Column) -> DataFrame:
    """Hash, size, type and stored name. ``suffix`` stands for the upload's unique part."""
    clean = R.sanitize_file_name(F.col("filename"))
    ext = R.file_extension(clean)
    pairs = [F.lit(x) for item in K.MIME_BY_EXTENSION.items() for x in item]
    mime = F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit(K.MIME_DEFAULT))
    sha = F.sha2(F.col("content"), 256)
    dotted = F.when(clean == "..", F.lit("")).otherwise(F.regexp_extract(clean, r"(?s).(\.[^.]*)$", 1))
    stored = F.concat(
        F.col("user_id").cast("string"), F.lit("_"), F.substring(sha, 1, 16), F.lit("_"), suffix, dotted
    )
    return files.select(
        "id",
        "user_id",
        clean.alias("clean_name"),
        mime.alias("mime"),
        sha.alias("sha256"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        stored.alias("stored_name"),
    )


def decode_text(files: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Bytes to text: valid UTF-8 stays in the JVM, the other charsets go through Arrow."""

    encodings = K.TEXT_ENCODINGS

    @F.pandas_udf("string")
    def legacy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(raw):
            for encoding in encodings:
                try:
                    return raw.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return raw.decode("utf-8", errors="ignore")

        for batch in batches:
            yield batch.map(lambda raw: None if raw is None else one(bytes(raw)))

    raw = F.col(content)
    as_text = raw.cast("string")
    valid = F.is_valid_utf8(as_text)
    # Only the rows that need it carry bytes into Python.
    fallback = legacy(F.when(~valid, raw))
    return files.withColumn(out, F.when(valid, as_text).otherwise(fallback))


def assemble_page_text(pages: DataFrame) -> DataFrame:
    """One text per document from (doc_id, page_no, text); blank pages are left out."""
    body = R.stripped_or_empty(F.col("text"))
    page = F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("]\n"), body)
    kept = pages.where(body != "").select("doc_id", F.struct("page_no", page.alias("page")).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["page"])
    return kept.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def table_row_text(cells: Column) -> Column:
    """Non-empty cells of a table row joined by bars."""
    clean = F.filter(F.transform(cells, lambda c: T.strip(c)), lambda c: c != "")
    return F.array_join(clean, " | ")


def duplicate_upload(documents: DataFrame) -> DataFrame:
    """Mark uploads whose (user, hash) was uploaded before; the first id wins.

    Only repeated hashes come back as ``firsts``; AQE splits a hot hash on the document side.
    """
    firsts = (
        documents.groupBy("user_id", "sha256")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("_copies"))
        .where(F.col("_copies") > 1)
        .drop("_copies")
    )
    repeated = F.col("first_id") < F.col("id")
    return (
        documents.join(firsts, ["user_id", "sha256"], "left")
        .withColumn("duplicate_of", F.when(repeated, F.col("first_id")))
        .withColumn("status_code", F.when(repeated, F.lit(409)).otherwise(F.lit(200)))
        .drop("first_id")
    )


def document_views() -> dict[str, Column]:
    status = F.col("status")
    return {
        "all": F.lit(True),
        "ready": status == "READY",
        "processing": status.isin(*K.PROCESSING_DOCUMENT_STATES),
        "failed": status == "FAILED",
    }


def filter_documents(documents: DataFrame, view: str) -> DataFrame:
    return documents.where(document_views()[view])


def filter_by_id(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; many lookups in one pass."""
    return table.join(wanted.select(key), key, "left_semi")


def documents_left_join_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its number of chunks (0 when it has none); chunks are counted before the join."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = documents.join(counts, documents["id"] == counts["doc_id"], "left")
    return joined.select(documents["id"], documents["status"], F.coalesce("n", F.lit(0)).alias("chunk_count"))


def corpus_counts(documents: DataFrame, chunks: DataFrame, fanout_compatible: bool = False) -> DataFrame:
    """Ready documents and all chunks in one row.

    ``fanout_compatible`` counts a ready document once per chunk row of the outer join.
    """
    per_doc = documents_left_join_chunks(documents, chunks)
    ready = (F.col("status") == "READY").cast("long")
    weight = F.greatest(F.col("chunk_count"), F.lit(1)) if fanout_compatible else F.lit(1)
    return per_doc.agg(
        F.coalesce(F.sum(ready * weight), F.lit(0)).alias("documents_ready"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
    )


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that point at a missing parent."""
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.join(keys, child_key, "left_anti")


def keep_linked(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """What a cascading delete leaves."""
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.join(keys, child_key, "left_semi")


def document_status_from_task(documents: DataFrame, latest_tasks: DataFrame) -> DataFrame:
    """Document row after its latest task: (doc_id, state, progress, chunk_count, error)."""
    t = latest_tasks.select(
        F.col("doc_id").alias("id"),
        F.col("state").alias("_state"),
        F.col("progress").alias("_progress"),
        F.col("chunk_count").alias("_chunks"),
        F.col("error").alias("_error"),
    )
    state = F.col("_state")
    status = (
        F.when(state.isNull(), F.col("status"))
        .when(state == "SUCCESS", F.lit("READY"))
        .when(state == "FAILURE", F.lit("FAILED"))
        .otherwise(F.lit("PROCESSING"))
    )
    return documents.join(t, "id", "left").select(
        "id",
        status.alias("status"),
        F.col("_progress").alias("progress"),
        F.coalesce("_chunks", "chunks").alias("chunks"),
        F.coalesce(state == "SUCCESS", F.lit(False)).alias("vectorized"),
        F.col("_error").alias("error"),
    )


def document_dashboard(documents: DataFrame) -> DataFrame:
    status = F.col("status")
    return documents.agg(
        F.count("*").alias("total"),
        F.count_if(status == "READY").alias("ready"),
        F.count_if(status.isin(*K.PROCESSING_DOCUMENT_STATES)).alias("processing"),
        F.count_if(status == "FAILED").alias("failed"),
        F.sum(F.when(status == "READY", F.col("chunks"))).alias("known_chunks"),
    )
