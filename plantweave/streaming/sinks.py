"""Micro-batch sinks: keyed tables and the publishing pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from plantweave.sources.sinks import KeyedTable


def upsert_each_batch(
    table: KeyedTable, keys: list[str], order: list[str]
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the latest row per key.

    The batch number is the version written, so a repeated batch changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, keys, order, batch_id)

    return run


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, append its rows to ``path`` and read them."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_available_batches(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Run a stream over what is there now through a batch function."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
