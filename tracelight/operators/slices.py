"""Targets and the samples around them, one slice of time at a time.

A join of targets with the samples in their windows makes a row of each pair, which grows with the square of a
recording's density. Here a slice's targets meet its samples (and those of a margin on either side) once, as arrays,
and a kernel reads sums and order statistics of every window off them: a sample is copied to a few slices at most."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000
SHORTEST_US = 600 * US


def per_slice(targets: DataFrame, samples: DataFrame, keys, kernel: Callable[[dict, dict], dict], fields: list[T.StructField], *, before_us: int, after_us: int, at: str = "t_us", asks: tuple[str, ...] = ()) -> DataFrame:
    """``targets`` with the kernel's columns. The kernel gets the columns ``at`` and ``asks`` of a slice's targets and all
    columns of the samples from ``before_us`` before to ``after_us`` after them, in time order, none null."""
    keys = list(keys)
    before_us, after_us = max(before_us, 0), max(after_us, 0)
    width = max(4 * (before_us + after_us), SHORTEST_US)
    carried = [c for c in samples.columns if c not in keys]
    left = targets.withColumn("_slice", F.floor(F.col(at) / width))
    right = samples.withColumn("_slice", F.explode(F.sequence(F.floor((F.col("t_us") - after_us) / width), F.floor((F.col("t_us") + before_us) / width))))
    schema = T.StructType([*targets.schema.fields, *fields])
    names, asked = targets.columns, [at, *asks]

    def arrays(table: pa.Table, columns) -> dict:
        return {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns}

    def run(own: pa.Table, around: pa.Table) -> pa.Table:
        found = own.select(names)
        points = arrays(around, carried)
        order = np.argsort(points["t_us"], kind="stable")
        new = kernel(arrays(own, asked), {c: x[order] for c, x in points.items()}) if own.num_rows else {f.name: [] for f in fields}
        for field in fields:
            kind = pa.int64() if isinstance(field.dataType, T.LongType) else pa.float64()
            column = new[field.name]
            found = found.append_column(field.name, pa.array(column, kind) if not isinstance(column, np.ma.MaskedArray) else pa.array(column.data, kind, mask=np.ma.getmaskarray(column)))
        return found

    return left.groupBy(*keys, "_slice").cogroup(right.groupBy(*keys, "_slice")).applyInArrow(run, schema)


def window_sums(events: DataFrame, samples: DataFrame, windows: dict[str, tuple[float, float]], values: list[str], keys) -> DataFrame:
    """Events with, for each window ``[event + a, event + b)``, the samples in it (``{window}_n``) and for each value the
    ones that are not null (``{window}_{value}_k``) and their mean (``{window}_{value}_m``)."""
    keys = list(keys)
    bounds = {name: tuple(int(round(x * US)) for x in window) for name, window in windows.items()}
    kept = samples.select(*keys, "t_us", *[c for v in values for c in (F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"v_{v}"), F.col(v).isNotNull().alias(f"k_{v}"))])

    def kernel(asked: dict, points: dict) -> dict:
        t, e, out = points["t_us"], asked["t_us"], {}
        places = {name: (np.searchsorted(t, e + a), np.searchsorted(t, e + b)) for name, (a, b) in bounds.items()}
        for name, (i, j) in places.items():
            out[f"{name}_n"] = j - i
        for v in values:
            x, odd = points[f"v_{v}"], ~np.isfinite(points[f"v_{v}"])
            count = np.concatenate([[0], np.cumsum(points[f"k_{v}"], dtype=np.int64)])
            # 64 bits of mantissa: what a difference of prefix sums loses stays below a double's last digit
            total = np.concatenate([np.zeros(1, np.longdouble), np.cumsum(np.where(odd, 0.0, x), dtype=np.longdouble)])
            strange = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
            for name, (i, j) in places.items():
                k = count[j] - count[i]
                mean = ((total[j] - total[i]) / np.maximum(k, 1)).astype(float)
                for p in np.flatnonzero(strange[j] > strange[i]):
                    mean[p] = x[i[p] : j[p]].sum() / k[p]
                out[f"{name}_{v}_k"], out[f"{name}_{v}_m"] = k, np.ma.array(mean, mask=k == 0)
        return out

    fields = [T.StructField(f"{n}_n", T.LongType()) for n in bounds] + [f for v in values for n in bounds for f in (T.StructField(f"{n}_{v}_k", T.LongType()), T.StructField(f"{n}_{v}_m", T.DoubleType()))]
    return per_slice(events, kept, keys, kernel, fields, before_us=-min(a for a, _ in bounds.values()), after_us=max(b for _, b in bounds.values()))
