"""Regions that arrive in a stream, mapped onto a fixed table of landmarks. An addition to what tables offer.

Each micro-batch is one interval join; counts and sums of batches add up, so a landmark's totals are right
whenever they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.aggs import total
from ..operators.regions import map_r


def map_stream(landmarks: DataFrame, arriving: DataFrame, path: str, checkpoint: str, value: str = "score", once: bool = True) -> StreamingQuery:
    """Writes, for each micro-batch, the landmarks that it hit with count and total to path/batch=<id>; a batch that is run again overwrites its own."""

    def put(batch: DataFrame, number: int) -> None:
        hit = map_r(landmarks, batch, total=total(value)).where(F.col("count") > 0)
        hit.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(landmarks: DataFrame, written: DataFrame) -> DataFrame:
    """Landmarks with what all batches wrote for them."""
    keys = landmarks.columns
    sums = written.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    out = landmarks.join(sums, keys, "left")
    return out.select(*keys, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0)).alias("total"))


