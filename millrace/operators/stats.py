"""Statistics of numeric and text attributes: moments, medians, running, temporal and seasonal aggregates, ranks,
correlations, covariance and Mahalanobis distance. Attributes are unpivoted once and aggregated once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.functions.transform import UNIT_MS
from millrace.operators.quantiles import exact_medians

#: Fixed value: scale of the median absolute deviation.
MAD_SCALE = 1.4296


def unpivot(df: DataFrame, attrs: Sequence[str], keep: Sequence[Column | str] = (), kind: str = "double") -> DataFrame:
    """keep, attr, value: one row per attribute."""
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast(kind).alias("value")) for a in attrs])
    return df.select(*keep, F.inline(cells))


def _seasoned(df: DataFrame, season: Column | None) -> tuple[DataFrame, list[str]]:
    return (df, []) if season is None else (df.withColumn("season_index", season).where("season_index >= 0"), ["season_index"])


def moments(x: DataFrame, by: Sequence[str]) -> DataFrame:
    return x.where("value is not null").groupBy(*by).agg(
        F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"), F.count("value").alias("count"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        F.stddev_pop("value").alias("std_dev"), F.min("value").alias("min"), F.max("value").alias("max"),
    )


def numerical_stats(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), cond: str | None = None, season: Column | None = None, min_count: int | None = None) -> DataFrame:
    """Per key [season] attribute [value of ``cond``]: sum, sum_sq, count, mean, variance, std_dev (population), min, max.

    With ``min_count``, only groups of more rows than that."""
    x, more = _seasoned(df, season)
    by = [*keys, *more, *([cond] if cond else [])]
    out = moments(unpivot(x, attrs, by), [*by, "attr"])
    return out if min_count is None else out.where(F.col("count") > min_count)


def string_stats(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The same over text lengths."""
    return moments(unpivot(df.select(*keys, *[F.length(a).alias(a) for a in attrs]), attrs, keys), [*keys, "attr"])


def median_stats(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), season: Column | None = None, mad: bool = False, mad_scale: float = MAD_SCALE) -> DataFrame:
    """Exact median per key [season] attribute, or the scaled median absolute deviation; no group is held in one task."""
    x, more = _seasoned(df, season)
    by = [*keys, *more, "attr"]
    cells = unpivot(x, attrs, by[:-1])
    med = exact_medians(cells, by, "value")
    if not mad:
        return med
    on = F.lit(True)
    m = med.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("median").alias("_median"))
    for k in by:
        on = on & cells[k].eqNullSafe(m[f"_{k}"])
    away = cells.join(m, on).select(*by, F.abs(F.col("value") - F.col("_median")).alias("value"))
    return exact_medians(away, by, "value").select(*by, "n", (F.col("median") * mad_scale).alias("mad"))


def running_merge(state: DataFrame, increment: DataFrame, keys: Sequence[str], attrs: Sequence[str], missing_as_zero: bool = False) -> DataFrame:
    """The aggregate so far (keys, attr, count, sum, sum_sq) with a new increment of rows: count, sum, sum_sq, avg, std_dev.

    ``missing_as_zero``: a key without rows in the increment counts as one row of 0."""
    new = numerical_stats(increment, attrs, keys).select(*keys, "attr", "count", "sum", "sum_sq")
    by = [*keys, "attr"]
    if missing_as_zero:
        zero = state.select(*by).join(new.select(*by), by, "left_anti").select(*by, F.lit(1).cast("long").alias("count"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("sum_sq"))
        new = new.unionByName(zero)
    x = state.select(*by, "count", "sum", "sum_sq").unionByName(new).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("count", "sum", "sum_sq")])
    avg = F.col("sum") / F.col("count")
    return x.withColumn("avg", avg).withColumn("std_dev", F.sqrt(F.greatest(F.col("sum_sq") / F.col("count") - avg * avg, F.lit(0.0))))


def _function(func: str):
    return {"count": F.count, "sum": F.sum, "average": F.avg}[func]


def temporal_aggregate(df: DataFrame, keys: Sequence[str], ts: Column, attrs: Sequence[str], unit: str, length: int, func: str, compact: bool = False) -> DataFrame:
    """Tumbling buckets of epoch milliseconds: count, sum or average per key, bucket and attribute (compact: a column each)."""
    width = UNIT_MS[unit] * length
    x = df.withColumn("bucket", ts - F.pmod(ts, F.lit(width)))
    if compact:
        return x.groupBy(*keys, "bucket").agg(*[_function(func)(a).alias(f"{func}_{a}") for a in attrs])
    return unpivot(x, attrs, [*keys, "bucket"]).groupBy(*keys, "bucket", "attr").agg(_function(func)("value").alias(func))


def seasonal_aggregate(df: DataFrame, keys: Sequence[str], attrs: Sequence[str], parent: Column, index: Column, func: str) -> DataFrame:
    """Per key, parent cycle, cycle index and attribute; points outside the cycle (index below 0) are left out."""
    x = df.withColumn("parent_cycle", parent).withColumn("cycle_index", index).where("cycle_index >= 0")
    by = [*keys, "parent_cycle", "cycle_index"]
    return unpivot(x, attrs, by).groupBy(*by, "attr").agg(_function(func)("value").alias(func))


def seasonal_cycles(counts: DataFrame, keys: Sequence[str], index: str, count: str, top_n: int | None = None, pct_above: float | None = None, max_entropy: float | None = None) -> DataFrame:
    """Modal cycles of a key: the top n by count, or those more than a percentage above the mean count; with ``max_entropy``
    only of keys whose distribution over the cycles has less entropy."""
    w = Window.partitionBy(*keys)
    x = counts
    if max_entropy is not None:
        p = F.col(count) / F.sum(count).over(w)
        x = x.withColumn("_p", p)
        e = x.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("_h")).where(F.col("_h") < max_entropy).select(*keys)
        x = x.join(e, list(keys), "left_semi").drop("_p")
    if top_n is not None:
        x = x.withColumn("_r", F.row_number().over(w.orderBy(F.col(count).desc(), F.col(index))))
        return x.where(F.col("_r") <= top_n).drop("_r")
    x = x.withColumn("_m", F.avg(count).over(w))
    return x.where(F.col(count) > F.col("_m") * (1 + pct_above / 100)).drop("_m")


def temporal_rate(df: DataFrame, begin: Column, end: Column, unit: str, window: float, output: str = "rate") -> DataFrame:
    """(end - begin) units per window length, per row."""
    return df.withColumn(output, (end - begin) * F.lit(float(UNIT_MS[unit])) / window)


def weighted_average(df: DataFrame, weights: dict[str, float], scale: float | None = None, maxima: dict[str, float] | None = None, invert: Sequence[str] = (), skip_zero: bool = False, output: str = "score") -> DataFrame:
    """Row score sum(w v) / sum(w); values may be scaled to their maximum, inverted (scale - v), and zeros left out."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for a, w in weights.items():
        v = F.col(a).cast("double")
        v = v * (scale or 1.0) / maxima[a] if maxima else v
        v = (scale or 1.0) - v if a in invert else v
        use = (v != 0) if skip_zero else F.lit(True)
        top, bottom = top + F.when(use, v * w).otherwise(0.0), bottom + F.when(use, F.lit(float(w))).otherwise(0.0)
    return df.withColumn(output, F.when(bottom > 0, top / bottom))


def aggregate_ranks(ranks: DataFrame, key: str, source: str, rank: str, how: str = "product", weights: dict[str, float] | None = None) -> DataFrame:
    """Ranks of a key from several lists merged: average, weightedAverage, median, max or product (geometric mean)."""
    r = F.col(rank).cast("double")
    if how == "median":
        return exact_medians(ranks, [key], rank).select(key, F.col("median").alias("merged_rank"))
    if how == "weightedAverage":
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        w = F.create_map(*pairs)[F.col(source)]
        agg = F.sum(w * r) / F.sum(w)
    else:
        agg = {"average": F.avg(r), "max": F.max(r), "product": F.exp(F.avg(F.log(r)))}[how]
    return ranks.groupBy(key).agg(agg.alias("merged_rank"))


def autocorrelation(df: DataFrame, keys: Sequence[str], seq: str, attrs: Sequence[str], lags: Sequence[int], max_only: bool = False) -> DataFrame:
    """Per key, attribute and lag: sum of (x_t - mean)(x_{t-lag} - mean) over the sum of squares."""
    x = unpivot(df, attrs, [*keys, seq])
    by = [*keys, "attr"]
    o = Window.partitionBy(*by).orderBy(seq)
    mean = F.avg("value").over(Window.partitionBy(*by))
    x = x.withColumn("_d", F.col("value") - mean)
    x = x.select(*by, "_d", *[F.lag("_d", k).over(o).alias(f"_l{k}") for k in lags])
    sums = x.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in lags])
    each = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_c{k}") / F.nullif(F.col("_v"), F.lit(0.0))).alias("correlation")) for k in lags])
    out = sums.select(*by, F.inline(each))
    return out if not max_only else out.groupBy(*by).agg(F.max_by("lag", "correlation").alias("lag"), F.max("correlation").alias("correlation"))


def crosscorrelation(df: DataFrame, keys: Sequence[str], seq: str, pairs: Sequence[tuple[str, str]], lags: Sequence[int]) -> DataFrame:
    """Per key, pair and lag (of either sign): mean product of standardised values, x_t with y_{t-lag}, over all rows of the key."""
    names = sorted({a for p in pairs for a in p})
    all_rows, o = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(seq)
    z = lambda a: (F.col(a) - F.avg(a).over(all_rows)) / F.nullif(F.stddev_pop(a).over(all_rows), F.lit(0.0))
    x = df.select(*keys, seq, *[z(a).alias(a) for a in names])
    cells = [(a, b, k, f"_x{i}") for i, (a, b, k) in enumerate((a, b, k) for a, b in pairs for k in lags)]
    x = x.select(*keys, *[(F.col(a) * F.lag(b, k).over(o)).alias(n) for a, b, k, n in cells])
    s = x.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(n).alias(n) for *_, n in cells])
    each = F.array(*[F.struct(F.lit(a).alias("attr1"), F.lit(b).alias("attr2"), F.lit(k).alias("lag"), (F.col(n) / F.col("_n")).alias("correlation")) for a, b, k, n in cells])
    return s.select(*keys, F.inline(each))


def covariance(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), ddof: int = 0, season: Column | None = None) -> DataFrame:
    """Per key [season] the mean vector and the covariance of every pair of attributes (i <= j): attr1, attr2, mean1, mean2, covariance."""
    df, more = _seasoned(df, season)
    keys = [*keys, *more]
    cov = F.covar_pop if ddof == 0 else F.covar_samp
    pairs = [(i, j) for i in range(len(attrs)) for j in range(i, len(attrs))]
    s = df.groupBy(*keys).agg(*[F.avg(a).alias(f"_m{i}") for i, a in enumerate(attrs)], *[cov(attrs[i], attrs[j]).alias(f"_c{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(attrs[i]).alias("attr1"), F.lit(attrs[j]).alias("attr2"), F.col(f"_m{i}").alias("mean1"), F.col(f"_m{j}").alias("mean2"), F.col(f"_c{i}_{j}").alias("covariance")) for i, j in pairs]
    return s.select(*keys, F.inline(F.array(*cells)))


def mahalanobis(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), output: str = "mahalanobis", saved: DataFrame | None = None) -> DataFrame:
    """Adds the distance of each row from its key's mean. The inverse is taken per key (a row of k x k numbers); singular
    matrices use the pseudo-inverse. Rows with nulls in an attribute get null.

    ``saved``: means and covariances of these keys, as ``covariance`` gives them, in place of those of ``df``; rows whose
    key they lack get null.
    """
    k = len(attrs)
    if saved is not None:
        at = {a: i for i, a in enumerate(attrs)}
        pair = lambda a, b: F.max(F.when((F.least(_place(at, "attr1"), _place(at, "attr2")) == min(at[a], at[b])) & (F.greatest(_place(at, "attr1"), _place(at, "attr2")) == max(at[a], at[b])), F.col("covariance")))
        whole = saved.groupBy(*keys).agg(*[F.max(F.when(F.col("attr1") == a, F.col("mean1")).when(F.col("attr2") == a, F.col("mean2"))).alias(f"_m{i}") for i, a in enumerate(attrs)], F.array(*[pair(a, b) for a in attrs for b in attrs]).alias("_c"))
    else:
        whole = df.dropna(subset=list(attrs)).groupBy(*keys).agg(*[F.avg(a).alias(f"_m{i}") for i, a in enumerate(attrs)], F.array(*[F.covar_pop(a, b) for a in attrs for b in attrs]).alias("_c"))

    @F.pandas_udf("array<double>")
    def inverse(c: pd.Series) -> pd.Series:
        return c.map(lambda m: np.linalg.pinv(np.array(m, float).reshape(k, k)).ravel().tolist())

    s = whole.withColumn("_i", inverse("_c")).drop("_c")
    x = df.join(s, list(keys), "left" if saved is not None else "inner") if keys else df.join(F.broadcast(s))  # one row without keys
    d = [F.col(a) - F.col(f"_m{i}") for i, a in enumerate(attrs)]
    q = sum((d[i] * d[j] * F.col("_i")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    return x.withColumn(output, F.when(q.isNotNull(), F.sqrt(F.greatest(q, F.lit(0.0))))).drop("_i", *[f"_m{i}" for i in range(k)])


def _place(at: dict[str, int], name: str) -> Column:
    return F.create_map(*[x for a, i in at.items() for x in (F.lit(a), F.lit(i))])[F.col(name)]


def moving_average(df: DataFrame, keys: Sequence[str], seq: str, attr: str, before: int, after: int = 0, output: str = "moving_average") -> DataFrame:
    return df.withColumn(output, F.avg(attr).over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(-before, after)))


def regression(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares slope, intercept and r2 of y on x per key."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def loess(df: DataFrame, keys: Sequence[str], seq: str, attr: str, span: int = 11, output: str = "smooth") -> DataFrame:
    """Locally weighted linear fit over the ``span`` nearest positions (tri-cube weights), by window sums in the JVM."""
    half = span // 2
    o = Window.partitionBy(*keys).orderBy(seq)
    near = F.collect_list(F.struct(F.col("_i").alias("i"), F.col(attr).cast("double").alias("v"))).over(o.rowsBetween(-half, half))
    x = df.withColumn("_i", F.row_number().over(o).cast("double")).withColumn("_near", near)
    at = F.transform("_near", lambda r: F.struct((r["i"] - F.col("_i")).alias("u"), r["v"].alias("v"), F.pow(1 - F.pow(F.abs(r["i"] - F.col("_i")) / (half + 1), F.lit(3.0)), F.lit(3.0)).alias("w")))
    total = lambda f: F.aggregate("_at", F.lit(0.0), lambda s, r: s + f(r))
    x = x.withColumn("_at", F.filter(at, lambda r: r["v"].isNotNull()))
    sums = {n: total(f) for n, f in {"w": lambda r: r["w"], "u": lambda r: r["w"] * r["u"], "v": lambda r: r["w"] * r["v"], "uu": lambda r: r["w"] * r["u"] * r["u"], "uv": lambda r: r["w"] * r["u"] * r["v"]}.items()}
    x = x.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
    det = F.col("_s_w") * F.col("_s_uu") - F.col("_s_u") * F.col("_s_u")
    fit = F.when(det > 1e-12, (F.col("_s_uu") * F.col("_s_v") - F.col("_s_u") * F.col("_s_uv")) / det).otherwise(F.col("_s_v") / F.nullif(F.col("_s_w"), F.lit(0.0)))
    return x.withColumn(output, fit).drop("_i", "_near", "_at", *[f"_s_{n}" for n in sums])


def ewma(df: DataFrame, keys: Sequence[str], seq: str, attr: str, step: float, output: str = "ewma") -> DataFrame:
    """Recency weighted average, avg += step * (v - avg), over all rows of a key so far; the first value starts it.

    Null values leave it as it is. Rows come in Arrow batches, in order; between them one number per key is carried.
    """
    ids = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, average = None, None
        for b in batches:
            averages = []
            columns = [b.column(k).to_pylist() for k in ids]
            for now, v in zip(zip(*columns, strict=True) if ids else [()] * b.num_rows, b.column("_v").to_pylist(), strict=True):
                if now != key:
                    key, average = now, None
                if v is not None:
                    average = v if average is None else average + step * (v - average)
                averages.append(average)
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(averages, pa.float64())], names=[*names, output])

    names = [c for c in df.columns if c != output]
    x = df.withColumn("_v", F.col(attr).cast("double"))
    x = (x.repartition(*ids) if ids else x.coalesce(1)).sortWithinPartitions(*ids, seq)
    schema = StructType([*[df.schema[c] for c in names], StructField(output, DoubleType())])
    return x.mapInArrow(run, schema)
