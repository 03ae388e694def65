"""Incremental harvest as a stream: the first sight of an id is kept, later ones are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import RECORD


def record_stream(spark: SparkSession, landing: str, schema: str = RECORD + ", repo string, seen timestamp") -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(landing)


def first_writes(stream: DataFrame, keys: tuple[str, ...] = ("repo", "id"), seen: str | None = None, delay: str = "30 days") -> DataFrame:
    """First row of each key.  With a time column the state is bounded by ``delay``; without, it holds every key."""
    if seen:
        return stream.withWatermark(seen, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def start(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a Parquet table; the checkpoint is the harvest's cursor."""
    w = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
