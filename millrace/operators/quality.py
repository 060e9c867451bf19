"""Data quality metrics, filters by quality, imputation and normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.missing import is_missing

ACCURACY_UNMATCHED = -0.001


def completeness_rows(df: DataFrame, weights: Mapping[str, float], tag: str | None = None) -> DataFrame:
    """Adds complete_fields and completeness: the weighted share of fields that are there."""
    there = {c: (~is_missing(F.col(c), tag)).cast("int") for c in weights}
    score = reduce(lambda a, b: a + b, [there[c] * float(w) for c, w in weights.items()]) / sum(weights.values())
    return df.select("*", reduce(lambda a, b: a + b, there.values()).alias("complete_fields"), score.alias("completeness"))


def completeness_columns(df: DataFrame, attrs: Sequence[str], tag: str | None = None) -> DataFrame:
    """attr, present, fraction, from one row of sums."""
    s = df.agg(F.count("*").alias("_n"), *[F.sum((~is_missing(F.col(c), tag)).cast("long")).alias(c) for c in attrs])
    cells = [F.struct(F.lit(c).alias("attr"), F.col(c).alias("present"), (F.col(c) / F.col("_n")).alias("fraction")) for c in attrs]
    return s.select(F.inline(F.array(*cells)))


def quality_rows(df: DataFrame, profiles: Mapping[str, Mapping[str, float]], tag: str | None = None) -> DataFrame:
    """Adds quality_<profile>: per profile the weighted share of fields that are there."""
    scores = []
    for name, weights in profiles.items():
        top = reduce(lambda a, b: a + b, [(~is_missing(F.col(c), tag)).cast("double") * float(w) for c, w in weights.items()])
        scores.append((top / sum(weights.values())).alias(f"quality_{name}"))
    return df.select("*", *scores)


def quality_columns(df: DataFrame, profiles: Mapping[str, Mapping[str, float]], tag: str | None = None) -> DataFrame:
    """profile, score: the weighted mean of the columns' fractions."""
    names = sorted({c for w in profiles.values() for c in w})
    s = df.agg(*[F.avg((~is_missing(F.col(c), tag)).cast("double")).alias(c) for c in names])
    cells = [F.struct(F.lit(p).alias("profile"), (reduce(lambda a, b: a + b, [F.col(c) * float(x) for c, x in w.items()]) / sum(w.values())).alias("score")) for p, w in profiles.items()]
    return s.select(F.inline(F.array(*cells)))


def accuracy(target: DataFrame, master: DataFrame, keys: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Per target row the fields that equal the master's (nulls are equal) and their weighted share; -0.001 without a master row."""
    m = master.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in weights], F.lit(True).alias("_there"))
    x = target.join(m, list(keys), "left")
    same = {c: F.col(c).eqNullSafe(F.col(f"_m_{c}")).cast("int") for c in weights}
    score = reduce(lambda a, b: a + b, [same[c] * float(w) for c, w in weights.items()]) / sum(weights.values())
    known = F.col("_there").isNotNull()
    return x.select(*target.columns, F.when(known, reduce(lambda a, b: a + b, same.values())).otherwise(0).alias("matched_fields"), F.when(known, score).otherwise(ACCURACY_UNMATCHED).alias("accuracy"))


def aggregate_quality(df: DataFrame, weights: Mapping[str, float], output: str = "quality") -> DataFrame:
    """Adds the weighted mean of several metrics of a row."""
    return df.withColumn(output, reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in weights.items()]) / sum(weights.values()))


def filter_by_quality(df: DataFrame, thresholds: Mapping[str, float]) -> dict[str, DataFrame]:
    """Per profile the rows above its threshold, without the metric columns."""
    names = [f"quality_{p}" for p in thresholds]
    return {p: df.where(F.col(f"quality_{p}") > t).drop(*names) for p, t in thresholds.items()}


def impute_nn(neighbours: DataFrame, ident: str, values: Mapping[str, str], distance: str, factor: float = 1.0, strategy: str = "model", same_class: tuple[str, str] | None = None, min_neighbours: int = 0, seed: int = 1) -> DataFrame:
    """ident and an imputed value per attribute from the neighbours of a record (one row each, with its distance).

    ``values``: attribute -> "numeric" (expectation under the weights) or "categorical" (the heaviest value). Weight
    (1 / distance) ** factor, distances below 1e-6 counting as that. Strategy "sample" draws one neighbour by weight
    instead (exponential races, by a hash of ids and the seed). ``same_class``: (own, neighbour) class columns that must agree.
    Records with fewer than ``min_neighbours`` are left out.
    """
    x = neighbours.where(F.col(same_class[0]) == F.col(same_class[1])) if same_class else neighbours
    x = x.withColumn("_w", F.pow(1 / F.greatest(F.col(distance).cast("double"), F.lit(1e-6)), F.lit(float(factor))))
    if min_neighbours:
        x = x.withColumn("_n", F.count("*").over(Window.partitionBy(ident))).where(F.col("_n") >= min_neighbours)
    out = None
    for a, kind in values.items():
        v = x.where(F.col(a).isNotNull())
        if strategy == "sample":
            u = (F.pmod(F.xxhash64(ident, a, F.lit(seed)), F.lit(2**31)) + 1) / F.lit(2.0**31 + 1)
            got = v.groupBy(ident).agg(F.min_by(a, F.struct(-F.log(u) / F.col("_w"), F.col(a))).alias(f"imputed_{a}"))
        elif kind == "numeric":
            got = v.groupBy(ident).agg((F.sum(F.col("_w") * F.col(a)) / F.sum("_w")).alias(f"imputed_{a}"))
        else:
            votes = v.groupBy(ident, a).agg(F.sum("_w").alias("_s"))
            got = votes.groupBy(ident).agg(F.min_by(a, F.struct(-F.col("_s"), F.col(a))).alias(f"imputed_{a}"))
        out = got if out is None else out.join(got, ident, "full")
    return out


PRE = {"additiveInverse": lambda c: -c, "multiplicativeInverse": lambda c: F.try_divide(F.lit(1.0), c), None: lambda c: c}


def normalize(df: DataFrame, attrs: Sequence[str], strategy: str, scale: float = 1.0, trunc: float | None = None, unit_range: bool = True, pre: str | None = None, keys: Sequence[str] = (), ddof: int = 0, drop_outliers: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """The attributes normalised by minMax, max, zScore, center, decimal or unitSum, times ``scale``.

    zScore: with ``trunc``, values beyond +- trunc are held there (or their rows dropped) and, with ``unit_range``,
    brought to [0, 1]. decimal: by the least power of ten above the largest magnitude. ``pre``: additiveInverse or
    multiplicativeInverse first. Constant attributes give null, where the spread is the divisor. One aggregation.

    ``stats``: saved statistics in place of those of ``df``, as ``numerical_stats`` gives them: the keys, attr, sum, mean,
    std_dev, min and max of the values after ``pre``. Rows whose key they lack get null.
    """
    p = {a: PRE[pre](F.col(a).cast("double")) for a in attrs}
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    if stats is not None:
        names = {"lo": F.col("min"), "hi": F.col("max"), "m": F.col("mean"), "s": F.col("std_dev"), "t": F.col("sum"), "x": F.greatest(F.abs("min"), F.abs("max"))}
        s = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("attr") == a, c)).alias(f"_{n}_{a}") for a in attrs for n, c in names.items()])
    else:
        s = df.groupBy(*keys).agg(*[f(p[a]).alias(f"_{n}_{a}") for a in attrs for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", sd), ("t", F.sum), ("x", lambda c: F.max(F.abs(c))))])
    x = df.join(s, list(keys), "left" if stats is not None else "inner") if keys else df.join(F.broadcast(s))  # one row without keys
    keep, out = [], {}
    for a in attrs:
        lo, hi, m, dev, total, most = (F.col(f"_{n}_{a}") for n in ("lo", "hi", "m", "s", "t", "x"))
        zero = F.lit(0.0)
        if strategy == "zScore":
            v = (p[a] - m) / F.nullif(dev, zero)
            if trunc is not None:
                keep.append(F.abs(v) <= trunc)
                v = F.greatest(F.least(v, F.lit(float(trunc))), F.lit(-float(trunc)))
                v = (v + trunc) / (2 * trunc) if unit_range else v
        else:
            v = {
                "minMax": (p[a] - lo) / F.nullif(hi - lo, zero), "max": p[a] / F.nullif(hi, zero), "center": p[a] - m, "unitSum": p[a] / F.nullif(total, zero),
                "decimal": p[a] / F.pow(F.lit(10.0), F.when(most > 0, F.floor(F.log10(F.nullif(most, zero))) + 1).otherwise(0)),
            }[strategy]
        out[a] = v * scale
    if drop_outliers and keep:
        x = x.where(reduce(lambda a, b: a & b, keep))
    return x.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])
