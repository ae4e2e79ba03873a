"""Joins by time: ranges in buckets, brackets, nearest samples, containment and overlap.

A range condition alone plans a nested loop. Each join here has an equality: the recording's keys and
a time bucket as wide as the longest range, so that every row meets two or a few buckets and long
recordings are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("subject", "session")
HOUR_US = 3_600_000_000


def range_join(points: DataFrame, ranges: DataFrame, keys=KEYS, *, point: str = "t_us", start: str = "start_us", stop: str = "stop_us", bucket_us: int, closed: bool = False, how: str = "inner", packed: bool = False) -> DataFrame:
    """Rows of ``ranges`` with the rows of ``points`` inside ``[start, stop)`` (``[start, stop]`` if closed).

    Ranges longer than a bucket are listed under each bucket they touch. ``how`` is inner or left
    (ranges without points stay, with null point columns). ``packed``: a bucket's points meet its ranges as one array,
    which is unrolled where it is; for points so dense that the result dwarfs both tables."""
    keys = list(keys)
    own = ranges.withColumn("_rid", F.monotonically_increasing_id()) if how == "left" else ranges
    first, last = F.floor(F.col(start) / bucket_us), F.floor(F.col(stop) / bucket_us)
    listed = own.where(F.col(stop) >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    extra = [c for c in points.columns if c not in keys]
    dealt = points.select(*[F.col(k).alias(f"_p_{k}") for k in keys], *[F.col(c).alias(f"p_{c}") for c in extra], F.floor(F.col(point) / bucket_us).alias("_pb"))
    t = F.col(f"p_{point}")
    inside = (t >= F.col(start)) & ((t <= F.col(stop)) if closed else (t < F.col(stop)))
    same = [F.col(k) == F.col(f"_p_{k}") for k in keys] + [F.col("_bucket") == F.col("_pb")]
    helpers = ["_bucket", "_pb", *[f"_p_{k}" for k in keys]]
    if packed:
        own_key = ["_pb", *[f"_p_{k}" for k in keys]]
        arrays = dealt.groupBy(*own_key).agg(F.collect_list(F.struct(*[F.col(f"p_{c}") for c in extra])).alias("_points"))
        # the tables are small beside the result: Spark would put them into too few tasks to share it out evenly
        spread = listed.repartition(4 * points.sparkSession.sparkContext.defaultParallelism, *keys, "_bucket")
        joined = spread.join(arrays, same).drop(*helpers).select(*own.columns, F.inline("_points")).where(inside)
    else:
        joined = listed.join(dealt, [*same, inside], "inner").drop(*helpers)
    if how == "inner":
        return joined
    missing = own.join(joined.select("_rid").distinct(), "_rid", "left_anti")
    return joined.unionByName(missing, allowMissingColumns=True).drop("_rid")


def bracket(targets: DataFrame, samples: DataFrame, keys=KEYS, *, time: str = "t_us", carry: tuple[str, ...]) -> DataFrame:
    """Targets with the last sample at or before and the first at or after them (``b_*`` and ``a_*`` columns).

    Both tables are laid in one order per key and hour and the neighbours read off it, without pairing; where an hour has
    none, they come from a small table of each hour's outermost samples."""
    keys = list(keys)
    hour = F.floor(F.col(time) / HOUR_US).alias("_hour")
    sides = samples.select(*keys, time, hour, F.lit(0).alias("_kind"), F.struct(F.col(time).alias("t_us"), *[F.col(c) for c in carry]).alias("_s"), F.lit(None).cast(targets.select(F.struct("*")).schema[0].dataType).alias("_t"))
    asked = targets.select(*keys, time, hour, F.lit(1).alias("_kind"), F.lit(None).cast(sides.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_t"))
    both = sides.unionByName(asked)
    back = Window.partitionBy(*keys, "_hour").orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_hour").orderBy(F.col(time).desc(), F.col("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last("_s", ignorenulls=True).over(back)).withColumn("_a", F.last("_s", ignorenulls=True).over(ahead))
    hours = both.groupBy(*keys, "_hour").agg(F.max_by("_s", F.when(F.col("_kind") == 0, F.col(time))).alias("_last"), F.min_by("_s", F.when(F.col("_kind") == 0, F.col(time))).alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(*keys, "_hour", F.last("_last", ignorenulls=True).over(earlier).alias("_before"), F.last("_first", ignorenulls=True).over(later).alias("_after"))
    out = both.where("_kind = 1").join(hours, [*keys, "_hour"], "left").withColumn("_b", F.coalesce("_b", "_before")).withColumn("_a", F.coalesce("_a", "_after"))
    return out.select("_t.*", *[F.col(f"_b.{c}").alias(f"b_{c}") for c in ("t_us", *carry)], *[F.col(f"_a.{c}").alias(f"a_{c}") for c in ("t_us", *carry)])


def nearest(targets: DataFrame, samples: DataFrame, keys=KEYS, *, time: str = "t_us", carry: tuple[str, ...]) -> DataFrame:
    """Targets with the nearest sample (``n_*``); the earlier one where two are as near."""
    both = bracket(targets, samples, keys, time=time, carry=carry)
    before = F.col(time) - F.col("b_t_us") <= F.col("a_t_us") - F.col(time)
    use_before = F.col("a_t_us").isNull() | (F.col("b_t_us").isNotNull() & before)
    picked = [F.when(use_before, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"n_{c}") for c in ("t_us", *carry)]
    return both.select(*[c for c in targets.columns], *picked)


def overlap_us(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def overlap_join(left: DataFrame, right: DataFrame, keys=KEYS, *, bucket_us: int) -> DataFrame:
    """Pairs of intervals that share time; right columns get ``c_``. Pairs are found in the bucket where their overlap begins."""
    keys = list(keys)

    def listed(df, prefix):
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"{prefix}start_us") / bucket_us), F.floor(F.col(f"{prefix}stop_us") / bucket_us))))

    a = listed(left, "")
    b = listed(right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns]), "c_").withColumnRenamed("_bucket", "_cb")
    begins = F.greatest("start_us", "c_start_us")
    cond = [a[k] == b[f"c_{k}"] for k in keys] + [a["_bucket"] == b["_cb"], F.least("stop_us", "c_stop_us") > begins, F.floor(begins / bucket_us) == F.col("_bucket")]
    return a.join(b, cond).drop("_bucket", "_cb", *[f"c_{k}" for k in keys])


def pairs_within(left: DataFrame, right: DataFrame, keys=KEYS, *, tolerance_us: int, time: str = "t_us") -> DataFrame:
    """Left rows flagged ``matched`` if a right row lies within the tolerance."""
    near = nearest(left, right.select(*keys, time).distinct(), keys, time=time, carry=())
    return near.withColumn("matched", F.coalesce(F.abs(F.col(time) - F.col("n_t_us")) <= tolerance_us, F.lit(False))).drop("n_t_us")
