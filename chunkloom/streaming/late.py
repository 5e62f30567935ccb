"""Rows that come too late for their window, kept in a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def run_with_late_rows(stream: DataFrame, event_time: str, delay_seconds: int, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Drain ``stream`` and return (on-time rows, late rows) of all runs so far.

    A row is late if its time lies more than the delay before the latest time of earlier batches, which is
    the watermark that stateful operators use. Every batch writes its own folders and its latest time, so a repeated batch
    replaces itself, and nothing is lost: late rows can be merged into their windows by a batch job.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        latest = None
        if batch_id > 0:
            clock = spark.read.schema("latest timestamp").parquet(*[f"{path}/clock/batch={i}" for i in range(max(0, batch_id - 1), batch_id)])
            latest = clock.agg(F.max("latest")).head()[0]
        limit = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay_seconds} SECONDS")
        late = F.coalesce(F.col(event_time) < limit, F.lit(False))
        # The running maximum goes from batch to batch, so only the one before is read.
        own = batch.agg(F.max(event_time).cast("timestamp").alias("latest"))
        own.select(F.greatest("latest", F.lit(latest).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def rows(kind: str) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{kind}")

    return rows("on_time"), rows("late")
