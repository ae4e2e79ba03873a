"""Canonical tables over the driver's star schema, in Spark and in SQL.

samples: the event stream as recordings, one per animal (user id modulo 12) and day; values over 200 count as
saturated, so missing. markers: purchases and errors as experimental events. bouts: each event as an interval of as
many minutes as its value, floored, plus one. observations: line items of customers' orders. traces: embeddings as
regular series of 64 samples at 20 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import tasks_for

KEYS = ("subject", "session")
CEILING = 200.0
RATE_HZ = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.concat(F.lit("a"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("subject"), F.date_format("ts", "yyyy-MM-dd").alias("session"), t_us.alias("t_us"), (t_us / 1e6).alias("t"),
        F.when(F.col("value") <= CEILING, F.col("value")).alias("signal"), F.regexp_extract("props", r'"k": *(-?\d+)', 1).cast("double").alias("reference"), "event_type", "event_id", "value",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select(*KEYS, "t_us", "t", "signal", "reference", "event_type")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).select(*KEYS, F.col("event_id").cast("string").alias("event_id"), "t_us", F.col("event_type").alias("condition"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = (F.floor("value") + 1) * 60_000_000
    return _stream(spark, sf_dir).select(*KEYS, F.col("event_id").cast("string").alias("interval_id"), F.col("event_type").alias("label"), F.col("t_us").alias("start_us"), (F.col("t_us") + minutes).alias("stop_us"), (F.col("reference") / 100).alias("confidence"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = tasks_for(items, orders)
    items = items.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice").repartition(tasks, "l_orderkey")
    orders = orders.select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").alias("animal"), F.col("l_orderkey").alias("session"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("observation"), F.col("l_returnflag").alias("condition"), (F.col("l_extendedprice") / 1000).alias("outcome"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("idx", "value"))
    return rows.select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("subject"), F.col("vec_id").cast("string").alias("session"), "idx", (F.col("idx") * 50_000).cast("long").alias("t_us"), F.col("value").cast("double").alias("signal"))


#: The same tables in SQL, to be put in front of a query.
SQL = {
    "samples": """samples as (select 'a' || lpad((user_id % 12)::varchar, 2, '0') as subject, strftime(ts, '%Y-%m-%d') as session, epoch_us(ts) as t_us, epoch_us(ts) / 1e6 as t,
  case when value <= 200 then value end as signal, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::double as reference, event_type, event_id, value from events)""",
    "markers": """markers as (select subject, session, event_id::varchar as event_id, t_us, event_type as condition from samples where event_type in ('purchase', 'error'))""",
    "bouts": """bouts as (select subject, session, event_id::varchar as interval_id, event_type as label, t_us as start_us, t_us + (floor(value)::bigint + 1) * 60000000 as stop_us, reference / 100 as confidence from samples)""",
    "observations": """observations as (select o_custkey as animal, l_orderkey as session, l_returnflag as condition, l_extendedprice / 1000 as outcome from lineitem join orders on l_orderkey = o_orderkey)""",
    "traces": """traces as (select 'g' || label::varchar as subject, vec_id::varchar as session, i - 1 as idx, (i - 1) * 50000 as t_us, embedding[i]::double as signal from (select label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))""",
}


def with_views(*names: str, sql: str) -> str:
    """``sql`` starts with its own common tables or with ``select``."""
    body = sql.strip()
    own = body[5:] if body.lower().startswith("with ") else None
    parts = [SQL[n] for n in names]
    return "with " + ",\n".join(parts) + (",\n" + own if own is not None else "\n" + body)
