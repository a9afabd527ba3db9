"""Structured Streaming jobs: windowed counts, retention, continuous scoring, term counts from changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from searchloom.operators import anomaly


def tumbling(stream: DataFrame, time: str, span: str, late: str, by: list[str] | None = None) -> DataFrame:
    """Counts per window; rows later than ``late`` are left out and old windows are dropped from the state."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, span), *(by or [])).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Counts per session: rows of one key without a pause longer than ``gap``."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def deduplicate(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows delivered again within ``late`` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run(stream: DataFrame, target: str, checkpoint: str, partition: list[str] | None = None, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write a stream to Parquet; with ``once`` all that is there is processed, then the query ends."""
    w = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode)
    if partition:
        w = w.partitionBy(*partition)
    return (w.trigger(availableNow=True) if once else w).start()


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call ``f`` with every micro-batch, for sinks that merge."""
    w = stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def datafeed(stream: DataFrame, history: Callable[[], DataFrame], keep: Callable[[DataFrame], None], publish: Callable[[DataFrame], None], checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Continuous anomaly scoring: each batch of buckets joins the history, and the newly scored ones are published."""

    def step(batch: DataFrame, _: int) -> None:
        past = history()
        scored = anomaly.score(past.unionByName(batch), by)
        keys = [*(by or []), "bucket"]
        publish(scored.join(batch.select(*keys), keys, "left_semi"))
        keep(batch)

    return each_batch(stream, step, checkpoint)
