"""Assembly of the streaming job."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dockline.operators import clean, windows
from dockline.streaming import sinks


def parsed(messages: DataFrame) -> DataFrame:
    return clean.parse(messages).withColumnRenamed("stationCode", "station_code")


def availability(messages: DataFrame, delay: str = "10 minutes", duration: str = "5 minutes") -> DataFrame:
    """Validated, deduplicated, windowed: the stateful branch."""
    return windows.availability(clean.deduplicate_stream(clean.validate(parsed(messages)), delay), duration)


def start_hot(messages: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Changed windows of every batch to ``writer`` (update mode)."""
    return availability(messages).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(writer).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def start_cold(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Validated rows to the history (append mode). Stateless, so it shares nothing with the hot branch."""
    return sinks.start_history(clean.validate(parsed(messages)), path, checkpoint, **trigger)


def run(spark: SparkSession, start: Callable[[], list[StreamingQuery]], restarts: int = 3, pause: float = 10.0) -> None:
    """Start the queries and block until one ends; start again from the checkpoints after a failure, ``restarts`` times."""
    for left in range(restarts, -1, -1):
        queries = start()
        try:
            spark.streams.awaitAnyTermination()
            return
        except Exception:
            if not left:
                raise
            for q in queries:
                q.stop()
            spark.streams.resetTerminated()
            time.sleep(pause)
