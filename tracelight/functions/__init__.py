"""Column expressions shared by the operators, and the tasks a table needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of input files to a task where a whole table is grouped by its rows' own keys: about half a million line items.
TASK_BYTES = 8 << 20
#: Beyond so many tasks a task's share grows, and its sorts spill.
MOST_TASKS = 20_000


def tasks_for(*tables: DataFrame) -> int:
    """Tasks for the rows of tables, by the size of the files below them: a task's share stays the same as they grow.

    Left to itself, Spark joins a shuffle's partitions until one has up to 64 MB compressed, many times that in memory."""
    size = 0
    for table in tables:
        leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= 1 << 60:  # a table whose size is not known counts as endless
        return int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(1, -(-size // TASK_BYTES)), MOST_TASKS)


def finite(x: Column) -> Column:
    """NaN and the infinities become null: null is the one mark of a missing sample."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def r6(x: Column) -> Column:
    """Rounded for output; adding zero turns -0.0 into 0.0."""
    return F.round(x.cast("double"), 6) + F.lit(0.0)


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Straight-line value at ``t`` between two samples; the first sample's value where both are at one time."""
    return F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * ((t - t0) / (t1 - t0)))


def sample_count(duration: float, rate: float) -> int:
    """Samples of a grid over ``duration`` with both ends: halves round to even."""
    return int(round(duration * rate)) + 1


def fraction(part: Column, whole: Column) -> Column:
    """A share of counts, 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def fisher_z(r: Column) -> Column:
    """Inverse hyperbolic tangent, with correlations kept off +-1."""
    r = F.greatest(F.lit(-1 + 1e-15), F.least(F.lit(1 - 1e-15), r))
    return F.lit(0.5) * F.log((1 + r) / (1 - r))


def hedges(df: Column, scale: int) -> Column:
    """Small-sample correction 1 - 3 / (4 df - scale)."""
    return 1 - 3 / (4 * df - scale)
