"""The scan over a stream of fetched resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan_fetched


def scan_stream(fetches: DataFrame, watermark: str = "1 day", **options) -> DataFrame:
    """Scan results of a streaming ``fetches`` with a timestamp column fetched_at; within the watermark each URL is scanned once.

    The scan itself holds no state, so it is the batch expression over the stream.
    """
    once = fetches.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["url"])
    return scan_fetched(once.withColumn("url", F.col("url")), **options)
