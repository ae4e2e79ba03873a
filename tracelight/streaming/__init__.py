"""Live counterparts of the binned summaries; the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_rates(stream: DataFrame, *, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes", keys: tuple[str, ...] = ("subject",), value: str = "value") -> DataFrame:
    """Events, mean and largest value per key and fixed window, kept open for late rows by a watermark."""
    return stream.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean", "largest")


def bursts(stream: DataFrame, *, time: str = "ts", gap: str = "5 minutes", late: str = "30 minutes", keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Compound groups: chains of events with gaps under ``gap``, as session windows."""
    return stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
