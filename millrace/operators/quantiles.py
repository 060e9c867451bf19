"""Exact grouped medians and percentiles without collecting a group.

Values are first counted per (group, value) with partial aggregation. An order-preserving coarse code (sign, logarithm in
1/256 steps) cuts every group into bins, whose counts give the bins that hold the wanted ranks; only the values of those
bins are then put in order. Where such a bin has more than ``limit`` distinct values it is cut again, into parts of
equal width between its smallest and largest value, and so on until all are small. So no task sorts more than ``limit``
values of a group, however large the group and however its values lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import written

BINS_PER_OCTAVE = 256
#: Parts a crowded bin is cut into.
PARTS = 4096


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], weight: str | None = None, limit: int = 100_000, counted: bool = False) -> DataFrame:
    """keys, n, p0, p1 ...: for each share the value at rank share * (n - 1), between ranks by linear interpolation.

    ``weight``: a column with how often the value occurs (default once a row). Null keys form a group of their own.
    A group without values gives no row. NaN sorts last, as Spark orders it. ``counted``: ``df`` is a written table that has
    few rows for one value already, so it is not counted and written again.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    counts = v.where("_v is not null and _w > 0")
    if not counted:
        counts = written(counts.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w")))
    size = F.when(F.isnan("_v"), F.lit(4000.0)).when(F.abs("_v") > 1.7976931348623157e308, F.lit(3000.0)).otherwise(F.log2(F.abs("_v")) + 1100)
    code = F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.when(F.isnan("_v"), F.lit(1.0)).otherwise(F.signum("_v")) * F.floor(size * BINS_PER_OCTAVE))
    near = counts.withColumn("_b", code.cast("long")).withColumn("_from", F.lit(0).cast("long")).withColumn("_n", F.lit(None).cast("long")).withColumn("_part", F.lit("").cast("string"))
    while True:
        bins = _wanted(near, keys, shares)
        crowded = bool(bins.where((F.col("_k") > limit) & (F.col("_min") < F.col("_max"))).limit(1).collect())
        near = _inside(near, bins, keys)
        if not crowded:
            break
        near = written(near)  # only the values of the wanted bins
        cut = (F.col("_k") > limit) & (F.col("_min") < F.col("_max")) & ~F.isnan("_max") & (F.abs("_min") <= 1.7976931348623157e308) & (F.abs("_max") <= 1.7976931348623157e308)
        at = F.floor((F.col("_v") / 2 - F.col("_min") / 2) / (F.col("_max") / 2 - F.col("_min") / 2) * (PARTS - 1)).cast("long")
        near = near.withColumn("_part", F.concat_ws(":", "_part", F.col("_b").cast("string"))).withColumn("_b", F.when(cut, at).otherwise(F.lit(0).cast("long")))
        near = near.select(*keys, "_v", "_w", "_part", "_b", F.col("_before").alias("_from"), "_n")
    inside = Window.partitionBy(*keys, "_part", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    at = lambda r: F.max(F.when((F.col("_at") <= r) & (r < F.col("_at") + F.col("_w")), F.col("_v")))
    out = near.groupBy(*keys).agg(F.max("_n").alias("n"), *[c for i, s in enumerate(shares) for c in (at(_rank(s)[0]).alias(f"_l{i}"), at(_rank(s)[1]).alias(f"_h{i}"))])
    rest = lambda s: (F.col("n") - 1) * F.lit(float(s)) - F.floor((F.col("n") - 1) * F.lit(float(s)))
    value_at = lambda i, s: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") * (1 - rest(s)) + F.col(f"_h{i}") * rest(s))
    return out.select(*keys, "n", *[value_at(i, s).alias(f"p{i}") for i, s in enumerate(shares)])


def _rank(share: float):
    """The ranks (from 0) on either side of a share."""
    at = (F.col("_n") - 1) * F.lit(float(share))
    return F.floor(at).cast("long"), F.ceil(at).cast("long")


def _wanted(near: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """The bins that hold a wanted rank, written: keys, _part, _b, _before (values before it), _n, _k distinct values, _min, _max."""
    order = Window.partitionBy(*keys, "_part").orderBy("_b")
    bins = near.groupBy(*keys, "_part", "_b").agg(F.sum("_w").alias("_c"), F.count("*").alias("_k"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.max("_from").alias("_from"), F.max("_n").alias("_n"))
    bins = bins.withColumn("_before", F.col("_from") + F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bins = bins.withColumn("_n", F.coalesce("_n", F.sum("_c").over(Window.partitionBy(*keys, "_part"))))
    holds = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")) for s in shares for r in _rank(s)]
    return written(bins.where(reduce(lambda a, b: a | b, holds)).drop("_c", "_from"))


def _inside(near: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """The values of the wanted bins, with what is known of the bin."""
    t = bins.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_tp"), F.col("_b").alias("_tb"), "_before", F.col("_n").alias("_tn"), "_k", "_min", "_max")
    on = (near["_b"] == t["_tb"]) & (near["_part"] == t["_tp"])
    for i, k in enumerate(keys):
        on = on & near[k].eqNullSafe(t[f"_k{i}"])
    x = near.drop("_n", "_from").join(t, on)
    return x.select(*[x[k] for k in keys], "_v", "_w", "_part", "_b", "_before", F.col("_tn").alias("_n"), "_k", "_min", "_max")


def exact_medians(df: DataFrame, keys: list[str], value: str, weight: str | None = None, limit: int = 100_000, counted: bool = False) -> DataFrame:
    """keys, n, median: the middle value, or the mean of the middle two, of the non-null values of each group."""
    return exact_percentiles(df, keys, value, [0.5], weight, limit, counted).withColumnRenamed("p0", "median")
