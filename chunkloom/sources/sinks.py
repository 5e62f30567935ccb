"""Writers: uploads, chunk and vector tables by document bucket, append-only metrics, citations, event text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.operators.chunks import index_row_id, vector_index_meta
from chunkloom.operators.retrieval import vector_blocks

DOC_BUCKETS = 64
#: More than the folders of files that one task writes: numbers of folders count up from the task's number times this.
TASK_FOLDERS = 1_000_000


def as_label(value: Column) -> Column:
    """Any text, or null, as the name of a folder; ``from_label`` leads back."""
    # "~" and "!" are escaped in urls, but not by Spark's writer; "*" would be a pattern.
    return F.coalesce(F.concat(F.lit("-"), F.translate(F.url_encode(value), "%*", "~!")), F.lit("null"))


def from_label(label: Column) -> Column:
    return F.when(label != "null", F.url_decode(F.translate(F.substring(label, F.lit(2), F.char_length(label)), "~!", "%*")))


def _store(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path in full."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store, store.makeQualified(given)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, if it lies among local or mounted files and not in another store."""
    uri = _store(spark, path)[1].toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _one_file_each(root: str, per_folder: int):
    """A task's rows as files below a folder of its attempt, which gets its name when all are there; a second attempt leaves the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, n = TaskContext.get().partitionId(), f"{root}/_attempt-{uuid.uuid4().hex}", 0
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                folder = f"{attempt}/folder={TASK_FOLDERS * task + n // per_folder}"
                if n % per_folder == 0:
                    labels = set()
                if label not in labels:
                    os.makedirs(f"{folder}/label={label}")
                    labels.add(label)
                with open(f"{folder}/label={label}/{n}.txt", "wb") as file:
                    file.write(text + b"\n")
                n += 1
        if n:
            done = f"{root}/task={task}"
            try:
                os.rename(attempt, done)
            except OSError:
                if not os.path.isdir(done):
                    raise
            yield pa.RecordBatch.from_arrays([pa.array([f"task={task}/{f}" for f in os.listdir(done)], pa.string())], ["folder"])

    return run


def write_files(rows: DataFrame, path: str, per_folder: int = 1000) -> list[str]:
    """Each row's ``text`` and a line end as a file of its own below ``label=<label>``; the folders above, of ``per_folder`` files at most.

    Labels are names as ``as_label`` makes them; a null text is an empty one. Hadoop's local file system starts a program for the rights of each
    file, and one for those of its checksum. So tasks write by themselves where ``path`` lies among local or mounted files, and Spark's writer
    serves all other stores.
    """
    spark = rows.sparkSession
    rows = rows.select("label", F.coalesce("text", F.lit("")).alias("text"))
    root = local_folder(spark, path)
    if root is not None:
        os.makedirs(root)
        made = rows.select("label", F.col("text").cast("binary").alias("text")).mapInArrow(_one_file_each(root, per_folder), "folder string")
        return [f"{path}/{r.folder}" for r in made.collect()]
    place = F.monotonically_increasing_id()
    folder = F.shiftright(place, 33) * TASK_FOLDERS + F.floor(place.bitwiseAND(2**33 - 1) / per_folder)
    writer = rows.select(folder.alias("folder"), "label", "text").write.partitionBy("folder", "label").option("maxRecordsPerFile", 1)
    # Files are moved as tasks end, not one by one by the driver.
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    store, full = _store(spark, path)
    return [f.getPath().toString() for f in store.listStatus(full) if f.isDirectory()]


def with_bucket(df: DataFrame, buckets: int = DOC_BUCKETS) -> DataFrame:
    return df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def write_chunks(new: DataFrame, path: str, old: DataFrame | None = None, buckets: int = DOC_BUCKETS) -> None:
    """Replace the chunks of re-ingested documents.

    Only buckets that hold such a document are rewritten: their other documents are carried
    over, and dynamic partition overwrite leaves all other buckets alone. ``old`` must not be
    read from ``path`` itself; pass a table written elsewhere.
    """
    fresh = with_bucket(new, buckets)
    out = fresh
    if old is not None:
        kept = with_bucket(old, buckets)
        touched = fresh.select("doc_bucket").distinct()
        stay = kept.join(F.broadcast(touched), "doc_bucket", "left_semi").join(
            new.select("doc_id").distinct(), "doc_id", "left_anti"
        )
        out = fresh.unionByName(stay)
    # Rebalance: few files per bucket, and a hot bucket is split over several tasks.
    out.hint("rebalance", "doc_bucket").write.partitionBy("doc_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_vector_index(vectors: DataFrame, path: str, buckets: int = DOC_BUCKETS) -> DataFrame:
    """Store (doc_id, row_id, chunk_id, chunk_index, content, embedding) and return the index meta."""
    indexed = index_row_id(vectors)
    with_bucket(indexed, buckets).hint("rebalance", "doc_bucket").write.partitionBy("doc_bucket").mode("overwrite").parquet(path)
    return vector_index_meta(vectors)


def write_vector_blocks(vectors: DataFrame, path: str, buckets: int = DOC_BUCKETS) -> None:
    """Store vectors as search blocks by document bucket, so that a search need not shuffle them."""
    blocks = with_bucket(vector_blocks(vectors), buckets)
    blocks.hint("rebalance", "doc_bucket").write.partitionBy("doc_bucket").mode("overwrite").parquet(path)


def metric_rows(records: DataFrame, extra: list[str]) -> DataFrame:
    """Flags as 0/1 and the extra fields as one JSON text, nulls included."""
    flags = {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("no_context", "timed_out")}
    return records.withColumns({**flags, "extra_json": F.to_json(F.struct(*extra), {"ignoreNullFields": "false"})}).drop(*extra)


def append_request_metrics(records: DataFrame, path: str, batch: str) -> None:
    """Add a batch by day. A batch that is written again replaces itself, so a retried job doubles nothing."""
    day = records.withColumn("created_day", F.to_date("created_at"))
    day.hint("rebalance", "created_day").write.mode("overwrite").partitionBy("created_day").parquet(f"{path}/batch={batch}")


def write_citations(citations: DataFrame, path: str, batch: str) -> None:
    """Add a batch; one that is written again replaces itself."""
    citations.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_sse_events(event_rows: DataFrame, path: str, batch: str) -> None:
    """Event text by stream bucket. The writer ends each row with one of the two closing newlines. A batch written again replaces itself."""
    bucket = F.pmod(F.xxhash64("stream_id"), F.lit(DOC_BUCKETS)).cast("int")
    text = F.regexp_replace("event_text", r"\n\z", "")
    rows = event_rows.select(text.alias("value"), bucket.alias("stream_bucket"))
    rows.hint("rebalance", "stream_bucket").write.partitionBy("stream_bucket").mode("overwrite").text(f"{path}/batch={batch}")
