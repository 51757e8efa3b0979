"""Structured Streaming over event tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000, kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def notify(stream: DataFrame, where: Column, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call with each batch of rows that meet the condition. The batch number tells a repeated batch after a failure."""
    writer = stream.where(where).writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need instants; times without zone are taken in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def windowed(stream: DataFrame, time: str, width: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates by time window and keys; rows later than ``late`` behind the newest are left out, and the state with them."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = _timed(stream, time).withWatermark(time, late).groupBy(w, *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "1 hour") -> DataFrame:
    """Aggregates by session: a pause longer than the gap starts a new one."""
    out = _timed(stream, time).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def latest_by_key(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key in a batch, for a table that follows a stream of changes."""
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("__row")).select("__row.*")
