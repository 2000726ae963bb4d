"""Scoring of documents as they arrive: an extension, for pools that grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_arrivals(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, id_col: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each micro-batch with its scores to ``sink``, a folder for each batch; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch.dropDuplicates([id_col])).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_metrics(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Mean and count of a metric by event-time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
