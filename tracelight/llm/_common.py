"""Shared plumbing of the text operators: durable intermediates and skew-proof joins."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of the ASCII white space every text operator here splits on.
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"

#: A key is hot when it holds at least 1/HOT_SHARE of all rows; so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000


#: Rows and bytes of an Arrow batch: texts and packed sets are long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20

_made: ContextVar[list | None] = ContextVar("made", default=None)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, unless the session asks for less.

    These settings are read when a plan runs, so they are set for the session and stay set."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def pieces(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for single rows, ``size`` bytes in a column of texts; an empty batch is one slice."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows or not at:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def give_back(run):
    """``run`` over a task's batches; at its end, what the worker has freed goes back to the system.

    Workers outlive tasks, and their allocators keep the pages of a task's texts for a later one, beside the memory
    of the JVM that needs them by then."""

    @wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, local mode (tests) gets a temporary one, which is recorded; a cluster is refused."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracelight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut by files that survive executors."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**(options or {})).parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


def tidy(operator):
    """The operator's result, whose rows are narrow, is written; the other tables it has written are deleted."""

    @wraps(operator)
    def run(*args, **options):
        token = _made.set([])
        try:
            out, made = operator(*args, **options), _made.get()
        finally:
            _made.reset(token)
        out = materialize(out, operator.__name__)
        for name in made:
            _delete(out.sparkSession, name)
        return out

    return run


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` to one row per key of ``groups`` that no hot key can pile onto one task.

    Keys that hold at least ``total / HOT_SHARE`` rows number at most HOT_SHARE (sizes add up to
    ``total`` at most), so they are broadcast; rows they answer get a salted key in the shuffled
    join that serves all other keys. The salt of those others is 0, but derived from the key: of a
    constant, the optimizer would make a condition and deal all rows by the bare key."""
    value_cols = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size_col) * HOT_SHARE >= F.lit(total))
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(c).alias(f"_hv_{c}") for c in value_cols], F.lit(True).alias("_is_hot"))
    cond = [rows[k] == F.col(f"_h_{k}") for k in keys]
    staged = rows.join(F.broadcast(hot), cond, "left").drop(*[f"_h_{k}" for k in keys])
    none = F.pmod(F.xxhash64(*keys), F.lit(1))
    staged = staged.withColumn("_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1).otherwise(none))
    cold = groups.where(F.col(size_col) * HOT_SHARE < F.lit(total)).withColumn("_c_salt", none)
    cold = cold.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(c).alias(f"_cv_{c}") for c in value_cols], "_c_salt")
    cond = [F.col(k) == F.col(f"_c_{k}") for k in keys] + [F.col("_salt") == F.col("_c_salt")]
    joined = staged.join(cold, cond, "left")
    out = [F.col(c) for c in rows.columns] + [F.coalesce(F.col(f"_hv_{c}"), F.col(f"_cv_{c}")).alias(c) for c in value_cols]
    return joined.select(*out)
