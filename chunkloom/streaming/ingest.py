"""Incremental ingest: new documents are chunked, embedded and stored batch by batch, in buckets that are kept compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.operators.chunks import chunk_documents, with_chunk_id
from chunkloom.operators.embedding import embed_chunks
from chunkloom.operators.ranking import last_per_key

#: Folders that documents are dealt out to by their id; a batch rewrites those that its documents are in.
BUCKETS = 64


def ingest_batch(documents: DataFrame) -> DataFrame:
    """Latest upload per document to embedded chunks."""
    latest = last_per_key(documents, ["doc_id"], F.col("version"))
    return embed_chunks(with_chunk_id(chunk_documents(latest.where("doc_id is not null"), keep=["version"])))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")


def current_folders(spark: SparkSession, path: str, before: int | None = None) -> dict[int, tuple[int, bool]]:
    """The batch that wrote each bucket last (of those below ``before``), and whether it has chunks there: a row for each bucket."""
    written = spark.read.schema("bucket int, chunks long, batch int").option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    if before is not None:
        written = written.where(F.col("batch") < before)
    latest = written.groupBy("bucket").agg(F.max_by(F.struct("batch", "chunks"), "batch").alias("w"))
    return {r.bucket: (r.w.batch, bool(r.w.chunks)) for r in latest.collect()}


def _read(spark: SparkSession, path: str, folders: dict[int, tuple[int, bool]]) -> tuple[DataFrame | None, DataFrame | None]:
    """Documents and chunks of the buckets' current folders; nothing of a kind that has none."""
    places = {kind: [f"{path}/{kind}/batch={b}/bucket={k}" for k, (b, chunks) in sorted(folders.items()) if chunks or kind == "current"] for kind in ("current", "chunks")}
    return tuple(spark.read.parquet(*found) if found else None for found in places.values())


def run_incremental_ingest(uploads: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Drain a stream of (doc_id, version, text); returns current chunks and document index rows.

    ``path`` and ``checkpoint`` belong together and are kept by the caller: a later run with the same two takes up where this
    one ended, after a crash as well. A batch reads and rewrites only the buckets that its documents are in: of each document
    the highest version stays, of equal versions the later one, with all its chunks and no others. It writes folders of its own
    and then a manifest of the buckets it wrote, so a repeated batch replaces itself and an unfinished one is not seen. The current view is one
    folder for each bucket, however many batches there were; folders that no bucket points to any more can be deleted between runs.
    """
    spark = uploads.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("doc_id").agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
        fresh = spark.read.parquet(f"{path}/documents/batch={batch_id}").withColumn("new", F.lit(True))
        touched = [r.bucket for r in fresh.select(_bucket(buckets)).distinct().collect()]
        known = current_folders(spark, path, batch_id) if batch_id else {}
        documents, chunks = _read(spark, path, {b: known[b] for b in touched if b in known})
        if documents is not None:
            fresh = fresh.unionByName(documents.withColumn("new", F.lit(False)))
        winners = fresh.groupBy("doc_id").agg(F.max(F.struct("version", "new")).alias("w")).select("doc_id", "w.version", "w.new")
        winners.select("doc_id", "version", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/current/batch={batch_id}")
        # Winners are told among documents: chunks and their vectors move once, to their buckets.
        kept = ingest_batch(batch.join(winners.where("new"), ["doc_id", "version"], "left_semi"))
        if chunks is not None:
            kept = kept.unionByName(chunks.join(winners.where("not new"), ["doc_id", "version"], "left_semi"))
        kept.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/chunks/batch={batch_id}")
        counts = spark.read.schema("doc_id long, bucket int").parquet(f"{path}/chunks/batch={batch_id}").groupBy("bucket").agg(F.count("*").alias("chunks"))
        every = winners.select(_bucket(buckets)).distinct().join(counts, "bucket", "left")
        every.select("bucket", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")

    query = (
        uploads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    documents, chunks = _read(spark, path, current_folders(spark, path))
    if chunks is None:
        chunks = ingest_batch(spark.createDataFrame([], "doc_id long, version int, text string"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    index = documents.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return chunks, index
