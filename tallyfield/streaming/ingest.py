"""Incremental ingest of new parts: restart-safe appends, newest row per key on read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators.windows import keep_last

BATCH = "ingest_batch"


def ingest_parts(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int | None = None
) -> None:
    """Take in all parts not seen before and stop.

    Each micro-batch overwrites its own folder ``ingest_batch=<id>``: a batch repeated after a
    failure replaces itself, and no batch rewrites what earlier ones wrote.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arriving = reader.parquet(source).selectExpr("*", "_metadata.file_name as read_file", "_metadata.row_index as read_row")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{BATCH}={batch_id}")

    query = (
        arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_rows(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key: by ``order`` if given, then by batch, file and row."""
    rows = spark.read.parquet(target)
    return keep_last(rows, keys, [*order, BATCH, "read_file", "read_row"]).drop(BATCH, "read_file", "read_row")


def arrivals_per_window(events: DataFrame, ts: str, width: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Counts per event-time window with a watermark; works on a stream and on a table."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(F.window(ts, width), *keys).agg(F.expr("count(*) as n"))
