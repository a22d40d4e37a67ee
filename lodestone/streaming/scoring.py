"""Stateless operators on streams, and windowed counts of what they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmeans import KMeansModel


def cluster_counts(stream: DataFrame, model: KMeansModel, time_col: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, cluster, n) for each tumbling window of a stream of points; rows later than `late` are dropped by the watermark.

    The same plan runs on a batch.
    """
    zoned = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks need a time zone: the session's
    labelled = model.transform(zoned).withWatermark(time_col, late)
    out = labelled.groupBy(F.window(time_col, window), "cluster").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "cluster", "n")
