"""The crawl as a stream: each batch of snapshot files is classified against the state so far and goes into the store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .store import Store, apply


def follow(spark: SparkSession, snapshots: str, schema: StructType, store: Store, checkpoint: str, as_of: datetime | None = None, complete: bool = False, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Reads new snapshot files under ``snapshots`` into the store, a file a batch.

    Without ``complete`` keys that a batch does not have keep their status.  Of
    several records of a key the first by the column ``position`` counts.  A
    batch that the stream runs again, after it broke off anywhere, ends as if
    it had run once.
    """

    def one(batch: DataFrame, number: int) -> None:
        apply(batch.sparkSession, store, batch, number, as_of, complete)
        if on_batch:
            on_batch(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(snapshots)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()


def reminders_once(events: DataFrame, delay: str = "10 days") -> DataFrame:
    """A stream of reminders (id, type, days_out, at) without repeats."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id", "type", "days_out"])
