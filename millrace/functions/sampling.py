"""Random columns and samples, reproducible by seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(lo: float, hi: float, seed: int) -> Column:
    return lo + (hi - lo) * F.rand(seed)


def uniform_int(lo: int, hi: int, seed: int) -> Column:
    """Whole numbers from lo to hi, both included."""
    return F.floor(F.rand(seed) * (hi - lo + 1) + lo).cast("long")


def normal(mean: float, std_dev: float, seed: int) -> Column:
    return mean + std_dev * F.randn(seed)


def exponential(rate: float, seed: int) -> Column:
    return -F.log(1 - F.rand(seed)) / rate


def poisson_events(rate: float, n: int, seed: int) -> Column:
    """An array of n arrival times of a Poisson process."""
    gaps = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: -F.log(1 - (F.pmod(F.xxhash64(i, F.rand(seed)), F.lit(2**31)) / F.lit(2.0**31))) / rate)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.aggregate(F.slice(gaps, 1, i), F.lit(0.0), lambda s, g: s + g))


def categorical(weights: Mapping[str, float], seed: int) -> Column:
    """A value with probability in proportion to its weight (inverse of the cumulative distribution)."""
    total, u = float(sum(weights.values())), F.rand(seed)
    edges, at = [], 0.0
    for v, w in weights.items():
        at += w / total
        edges.append((at, v))
    x = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(v).alias("v")) for e, v in edges])
    return F.element_at(F.filter(x, lambda s: (s["e"] > u) | (s["v"] == edges[-1][1])), 1)["v"]


def non_parametric(bins: Sequence[float], width: float, start: float, seed: int) -> Column:
    """A number from a histogram of equal bins: a bin by its weight, uniform within it."""
    index = categorical({str(i): w for i, w in enumerate(bins)}, seed).cast("int")
    return start + (index + F.rand(seed + 1)) * width


def random_text(length: int, seed: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    u = F.rand(seed)
    pick = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(i, u), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), pick), "")


def ranked(n: int, seed: int, decay: float = 0.5) -> Column:
    """A rank from 0 to n - 1, each ``decay`` times as likely as the one before."""
    return categorical({str(i): decay**i for i in range(n)}, seed).cast("int")


def stride_sample(df: DataFrame, order: Sequence[str], stride: int, seed: int) -> DataFrame:
    """About every stride-th row, one from each stretch of a hash of the order columns."""
    return df.where(F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(stride)) == 0)


def balance_classes(df: DataFrame, class_attr: str, seed: int = 100, ratio: float = 1.0) -> DataFrame:
    """Larger classes sampled down to ``ratio`` times the smallest. The class counts, one row a class, decide the fractions."""
    counts = df.groupBy(class_attr).agg(F.count("*").alias("_n")).where(F.col(class_attr).isNotNull())
    least = counts.agg(F.min("_n").alias("_least"))
    share = counts.join(F.broadcast(least)).withColumn("_share", F.least(F.lit(1.0), ratio * F.col("_least") / F.col("_n"))).select(class_attr, "_share")  # one row
    return df.withColumn("_u", F.rand(seed)).join(share, class_attr).where(F.col("_u") < F.col("_share")).select(*df.columns)
