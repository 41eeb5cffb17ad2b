"""Snapshots that arrive as files: each is compared with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import snapshot_diff


def follow(snapshots: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of component rows (a snapshot a batch) -> folder/changes, with folder/current as the last snapshot."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            snapshot_diff(spark.read.parquet(f"{folder}/snapshot={number - 1}"), batch).write.mode("overwrite").parquet(f"{folder}/changes={number}")
        batch.write.mode("overwrite").parquet(f"{folder}/snapshot={number}")

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
