"""Resumable runs: pages that were processed are skipped; results are appended exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def pending(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages without a result yet; running again with the same input does nothing."""
    return pages.join(done.select("project_id", "page_index").distinct(), ["project_id", "page_index"], "left_anti")


def process_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` over the JSON files that arrived since the last call and append its rows to ``sink`` (Parquet).

    The checkpoint remembers the files that were read, so a run that was
    stopped goes on where it ended; ``work`` must be row-wise.
    """
    stream = spark.readStream.schema(schema).json(source)
    return work(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batches(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """As ``process_available`` for work that needs whole batches (windows, joins): each batch replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
