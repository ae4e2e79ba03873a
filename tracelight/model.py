"""The data model: long tables of samples, events, intervals and observations with declared columns.

samples: subject, session, channel, t_us (integer microseconds), t (seconds), signal, reference;
events: subject, session, event_id, t_us, condition; intervals: subject, session, interval_id, label,
start_us, stop_us, confidence; observations: observation id, unit columns, factor columns, outcome.
A recording is the samples of one (subject, session, channel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import finite

RECORDING = ("subject", "session", "channel")

SAMPLES = T.StructType(
    [T.StructField("subject", T.StringType(), False), T.StructField("session", T.StringType(), False), T.StructField("channel", T.StringType(), False), T.StructField("t_us", T.LongType(), False), T.StructField("t", T.DoubleType(), False), T.StructField("signal", T.DoubleType()), T.StructField("reference", T.DoubleType())]
)
EVENTS = T.StructType([T.StructField("subject", T.StringType(), False), T.StructField("session", T.StringType(), False), T.StructField("event_id", T.StringType(), False), T.StructField("t_us", T.LongType(), False), T.StructField("condition", T.StringType())])
INTERVALS = T.StructType(
    [T.StructField("subject", T.StringType(), False), T.StructField("session", T.StringType(), False), T.StructField("interval_id", T.StringType(), False), T.StructField("label", T.StringType(), False), T.StructField("start_us", T.LongType(), False), T.StructField("stop_us", T.LongType(), False), T.StructField("confidence", T.DoubleType())]
)


def recording_window(keys=RECORDING):
    return Window.partitionBy(*keys).orderBy("t_us")


def make_recording(df: DataFrame, *, subject: Column, session: Column, time_us: Column, signals: dict[str, Column], reference: Column | None = None) -> DataFrame:
    """Canonical samples from any table: one row per time and channel, missing values null."""
    channels = [F.struct(F.lit(name).alias("channel"), finite(value).alias("signal")) for name, value in signals.items()]
    base = df.select(subject.cast("string").alias("subject"), session.cast("string").alias("session"), time_us.cast("long").alias("t_us"), finite(reference if reference is not None else F.lit(None)).alias("reference"), F.explode(F.array(*channels)).alias("_c"))
    return base.select("subject", "session", "_c.channel", "t_us", (F.col("t_us") / 1e6).alias("t"), "_c.signal", "reference")


def validate_recording(samples: DataFrame, keys=RECORDING) -> DataFrame:
    """One row per recording: sample count, clock violations and whether it holds (two samples at least, clock strictly rising)."""
    w = recording_window(keys)
    steps = samples.withColumn("_back", (F.lag("t_us").over(w) >= F.col("t_us")).cast("long"))
    out = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_back"), F.lit(0)).alias("violations"), F.count("signal").alias("n_finite"))
    return out.withColumn("valid", (F.col("n") >= 2) & (F.col("violations") == 0))


def require(problems: DataFrame, message: str) -> None:
    """Refuse when a table of problems has a row; the first one is told."""
    found = problems.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")
