"""Optional extension: events as a stream. The engine's own semantics are batch; these are the nearest streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_writes(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Idempotent append: the first event of each (project_id, idempotency_key) within the watermark."""
    return events.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["project_id", "idempotency_key"])


def activity(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and type; late ones count until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def to_log(events: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Each micro-batch is one commit, so a batch of events shows whole or not at all."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
