"""Run a stream to the end of its input and read its result as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.operators.ranking import last_per_key
from chunkloom.session import scratch_path


def read_stream(spark: SparkSession, folder: str, table: str, schema, max_files: int | None = None) -> DataFrame:
    """One parquet table of a folder as a file stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream into a parquet sink; returns the sink's table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Update-mode stream; each batch writes its changed rows, the last batch of a key counts.

    A repeated batch overwrites its own folder, so a restart changes nothing.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", state)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    return last_per_key(rows, keys, F.col("batch")).drop("batch")

