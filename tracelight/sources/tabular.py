"""Delimited recordings and events by declared column roles; nothing is inferred from values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import finite
from tracelight.model import make_recording

# Cells that mean missing, spellings of booleans, time units in microseconds.
MISSING = ("", "na", "nan", "null", "none")
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
UNITS = {"seconds": 1_000_000, "milliseconds": 1_000}


@dataclass(frozen=True)
class RecordingColumns:
    """Which column is the time and which columns are each channel's signal and reference."""

    time: str
    channels: dict[str, tuple[str, str | None]]
    unit: str = "seconds"
    delimiter: str | None = None


@dataclass(frozen=True)
class EventColumns:
    """Time and id columns, and the kind (string, float, int, bool) of each other column that is wanted."""

    time: str
    event_id: str
    columns: dict[str, str] = field(default_factory=dict)
    unit: str = "seconds"
    delimiter: str | None = None


def delimiter_of(path: str, declared: str | None) -> str:
    """The declared one, or that of the suffix; others are refused."""
    if declared:
        return declared
    for suffix, sep in ((".csv", ","), (".tsv", "\t"), (".tab", "\t")):
        if path.lower().endswith(suffix):
            return sep
    raise ValueError(f"declare a delimiter for {path!r}")


def _cells(spark: SparkSession, path: str, delimiter: str, wanted: list[str]) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", delimiter).option("mode", "FAILFAST").csv(path)
    lacking = [c for c in wanted if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path!r} has no columns {lacking}")
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in wanted])


def number(cell: Column, name: str) -> Column:
    """A finite number or null; what is neither a number nor a missing mark stops the read."""
    blank = cell.isNull() | F.lower(cell).isin(*MISSING)
    value = cell.try_cast("double")
    return F.when(blank, F.lit(None)).otherwise(F.coalesce(finite(value), F.when(F.lower(cell).rlike("inf"), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a number: "), cell)).cast("double"))))


def load_recording(spark: SparkSession, path: str, columns: RecordingColumns, *, subject: str, session: str) -> DataFrame:
    """Canonical samples of one wide file."""
    if columns.unit not in UNITS:
        raise ValueError(f"unknown time unit {columns.unit!r}")
    names = [columns.time, *{c for pair in columns.channels.values() for c in pair if c}]
    cells = _cells(spark, path, delimiter_of(path, columns.delimiter), list(dict.fromkeys(names)))
    time = F.round(number(F.col(columns.time), columns.time) * UNITS[columns.unit]).cast("long")
    time = F.coalesce(time, F.raise_error(F.lit("a sample has no time")).cast("long"))
    parts = [
        make_recording(cells, subject=F.lit(subject), session=F.lit(session), time_us=time, signals={name: number(F.col(signal), signal)}, reference=number(F.col(ref), ref) if ref else None)
        for name, (signal, ref) in columns.channels.items()
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def load_events(spark: SparkSession, path: str, columns: EventColumns, *, subject: str, session: str) -> DataFrame:
    """Events with typed columns; a cell that does not fit its kind stops the read."""
    cells = _cells(spark, path, delimiter_of(path, columns.delimiter), [columns.time, columns.event_id, *columns.columns])

    def typed(name: str, kind: str) -> Column:
        cell = F.col(name)
        if kind == "string":
            return cell
        if kind == "float":
            return number(cell, name)
        if kind == "int":
            return number(cell, name).cast("long")
        if kind == "bool":
            low = F.lower(cell)
            return F.when(cell.isNull() | low.isin(*MISSING), F.lit(None)).when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a boolean: "), cell)).cast("boolean"))
        raise ValueError(f"unknown kind {kind!r}")

    time = F.round(number(F.col(columns.time), columns.time) * UNITS[columns.unit]).cast("long")
    return cells.select(F.lit(subject).alias("subject"), F.lit(session).alias("session"), F.col(columns.event_id).alias("event_id"), time.alias("t_us"), *[typed(n, k).alias(n) for n, k in columns.columns.items()])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def detect_format(path: str, header: str | None = None) -> str:
    """Which reader a path calls for, by its name and, for delimited files, the header row."""
    low = path.lower().rstrip("/")
    for suffix, kind in ((".doric", "doric"), (".ppd", "pyphotometry"), (".nwb", "nwb"), (".tsq", "tdt"), (".tev", "tdt"), (".tbk", "tdt")):
        if low.endswith(suffix):
            return kind
    if low.endswith((".pqt", ".parquet")):
        return "ibl"
    if low.endswith((".csv", ".tsv", ".tab")):
        names = {c.strip().lower() for c in (header or "").replace("\t", ",").split(",")}
        led = names & {"ledstate", "flags"}
        return "neurophotometrics" if led and any(n.startswith(("region", "roi", "g")) for n in names - led) else "tabular"
    raise ValueError(f"no reader for {path!r}")


ANNOTATION = T.StructType([T.StructField(n, t) for n, t in (("subject", T.StringType()), ("session", T.StringType()), ("label", T.StringType()), ("kind", T.StringType()), ("start_us", T.LongType()), ("stop_us", T.LongType()))])


def annotations_from_aggregated(rows: DataFrame, *, subject: str, session: str, behavior: str, kind: str, start: str, stop: str) -> DataFrame:
    """Aggregated behaviour rows: POINT as points, STATE as intervals; other kinds stop the read."""
    what = F.upper(F.trim(F.col(kind)))
    told = F.when(what == "POINT", "point").when(what == "STATE", "interval").otherwise(F.raise_error(F.concat(F.lit("unknown behaviour type: "), F.col(kind))).cast("string"))
    us = lambda c: F.round(F.col(c).cast("double") * 1e6).cast("long")
    return rows.select(F.lit(subject).alias("subject"), F.lit(session).alias("session"), F.trim(F.col(behavior)).alias("label"), told.alias("kind"), us(start).alias("start_us"), F.when(what == "STATE", us(stop)).alias("stop_us"))


def load_aggregated(spark: SparkSession, path: str, *, subject: str, session: str, source_subject: str | None = None, source_observation: str | None = None) -> DataFrame:
    """An aggregated behaviour export; a file with several subjects or observations needs a choice."""
    rows = spark.read.option("header", True).option("sep", delimiter_of(path, None)).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    pick = lambda *options: next((names[o] for o in options if o in names), None)
    roles = {"behavior": pick("behavior", "behaviour"), "kind": pick("behavior type", "type"), "start": pick("start (s)", "start"), "stop": pick("stop (s)", "stop")}
    lacking = [k for k, v in roles.items() if v is None]
    if lacking:
        raise ValueError(f"{path!r} has no columns for {lacking}")
    for column, wanted in ((pick("subject"), source_subject), (pick("observation id", "observation"), source_observation)):
        if column is None:
            continue
        if wanted is not None:
            rows = rows.where(F.col(f"`{column}`") == wanted)
        elif rows.select(f"`{column}`").distinct().limit(2).count() > 1:
            raise ValueError(f"choose one of the column {column!r}")
    plain = rows.select(*[F.col(f"`{v}`").alias(k) for k, v in roles.items()])
    return annotations_from_aggregated(plain, subject=subject, session=session, behavior="behavior", kind="kind", start="start", stop="stop")
