"""Histograms as relations (group, bin, count), their summaries, and tests of fit between them.

A numeric bin is the value over the width truncated toward zero, so bin 0 reaches from -width to width; ``floor=True``
makes all bins equally wide. Merging histograms is adding counts. Summaries hold one group's bins, never its rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import broadcast_if_small
from millrace.operators.quantiles import exact_percentiles
from millrace.operators.stats import unpivot


def bin_of(value: Column, width: Column | float, floor: bool = False) -> Column:
    q = value.cast("double") / (width if isinstance(width, Column) else F.lit(float(width)))
    return F.floor(q).cast("int") if floor else q.cast("int")


def numeric_histogram(df: DataFrame, attrs: Sequence[str], widths: Mapping[str, float] | DataFrame, keys: Sequence[str] = (), season: Column | None = None, floor: bool = False, min_z: float | None = None) -> DataFrame:
    """keys, [season_index], attr, bin, width, count, sum, sum_sq. Widths per attribute, or a table of keys, attr, width.

    Nulls have no bin; groups without a width give no rows."""
    x = df if season is None else df.withColumn("season_index", season).where("season_index >= 0")
    by = [*keys, *(["season_index"] if season is not None else [])]
    cells = unpivot(x, attrs, by).where("value is not null")
    if isinstance(widths, DataFrame):
        on = [c for c in (*by, "attr") if c in widths.columns]
        cells = cells.join(broadcast_if_small(widths.select(*on, F.col("width").cast("double").alias("width"))), on)
    else:
        literal = F.create_map(*[F.lit(v) for kv in widths.items() for v in (kv[0], float(kv[1]))])
        cells = cells.withColumn("width", literal[F.col("attr")]).where("width is not null")
    cells = cells.withColumn("bin", bin_of(F.col("value"), F.col("width"), floor))
    return cells.groupBy(*by, "attr", "width", "bin").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"))


def prebinned(df: DataFrame, keys: Sequence[str], bin: str, count: str) -> DataFrame:
    """Counts that come binned already, added up."""
    return df.groupBy(*keys, F.col(bin).cast("int").alias("bin")).agg(F.sum(count).cast("long").alias("count"))


def joint_histogram(df: DataFrame, widths: Mapping[str, float | None], keys: Sequence[str] = ()) -> DataFrame:
    """Counts of joint bins, one column <attr>_bin each; attributes with width None are categories. Rows with a null are left out."""
    bins = [(F.col(a) if w is None else bin_of(F.col(a), w)).alias(f"{a}_bin") for a, w in widths.items()]
    names = [f"{a}_bin" for a in widths]
    return df.dropna(subset=list(widths)).select(*keys, *bins).groupBy(*keys, *names).agg(F.count("*").alias("count"))


def tag_bins(df: DataFrame, widths: Mapping[str, float], output: str = "bin_key") -> DataFrame:
    """Each row with the key of its joint bin."""
    return df.withColumn(output, F.concat_ws(":", *[bin_of(F.col(a), w).cast("string") for a, w in widths.items()]))


def merge(*histograms: DataFrame, by: Sequence[str]) -> DataFrame:
    x = histograms[0]
    for h in histograms[1:]:
        x = x.unionByName(h)
    return x.groupBy(*by).agg(*[F.sum(c).alias(c) for c in histograms[0].columns if c not in by])


def to_text(hist: DataFrame, by: Sequence[str], normalized: bool = False, sep: str = ",") -> DataFrame:
    """One text per group: "bin:count" (or share) in order of bins."""
    v = F.round(F.col("count") / F.sum("count").over(Window.partitionBy(*by)), 6) if normalized else F.col("count")
    rows = F.array_sort(F.collect_list(F.struct("bin", F.concat_ws(":", F.col("bin").cast("string"), F.col("_v").cast("string")).alias("t"))))
    return hist.withColumn("_v", v).groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias("text"))


def from_text(texts: DataFrame, by: Sequence[str], text: str = "text", sep: str = ",") -> DataFrame:
    """The histogram of texts of ``to_text`` with counts: by, bin, count."""
    x = texts.select(*by, F.explode(F.split(text, f"\\Q{sep}\\E")).alias("_t"))
    return x.select(*by, F.substring_index("_t", ":", 1).cast("int").alias("bin"), F.substring_index("_t", ":", -1).cast("long").alias("count"))


def shares(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds share (of the group's count) and cumulative share in order of bins."""
    w = Window.partitionBy(*by)
    x = hist.withColumn("share", F.col("count") / F.sum("count").over(w))
    return x.withColumn("cumulative", F.sum("share").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def summary(hist: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per group: count, mean, std_dev (sample), mode (centre of the fullest bin), entropy (ln), q<p> linear within the bin."""
    group = Window.partitionBy(*by)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumn("_n", F.sum("count").over(group)).withColumn("_cum", F.sum("count").over(upto)).withColumn("_lo", F.col("bin") * F.col("width"))
    p = F.col("count") / F.col("_n")
    n, s, q = F.sum("count"), F.sum("sum"), F.sum("sum_sq")
    aggs = [
        n.alias("count"), (s / n).alias("mean"), F.sqrt(F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))).alias("std_dev"),
        F.max_by(F.col("_lo") + F.col("width") / 2, F.struct(F.col("count"), -F.col("bin"))).alias("mode"), (-F.sum(p * F.log(p))).alias("entropy"),
    ]
    for at in quantiles:
        rank = F.col("_n") * at
        inside = F.when((F.col("_cum") >= rank) & (F.col("_cum") - F.col("count") < rank), F.col("_lo") + F.col("width") * (rank - (F.col("_cum") - F.col("count"))) / F.col("count"))
        aggs.append(F.min(inside).alias(f"q{round(at * 100)}"))
    return x.groupBy(*by).agg(*aggs)


def confidence_bounds(hist: DataFrame, by: Sequence[str], percent: float) -> DataFrame:
    """Per group low and high edges of the bins nearest to the mean that together hold ``percent`` of the count."""
    group = Window.partitionBy(*by)
    mean = F.sum("sum").over(group) / F.sum("count").over(group)
    x = hist.withColumn("_d", F.abs((F.col("bin") + 0.5) * F.col("width") - mean)).withColumn("_n", F.sum("count").over(group))
    before = F.coalesce(F.sum("count").over(group.orderBy("_d", "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_before", before).where(F.col("_before") < F.col("_n") * percent / 100)
    return x.groupBy(*by).agg(F.min(F.col("bin") * F.col("width")).alias("low"), F.max((F.col("bin") + 1) * F.col("width")).alias("high"))


def meta_distribution(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per bin the total share of the bins that are no more frequent than it."""
    x = shares(hist, by)
    w = Window.partitionBy(*by).orderBy("count").rangeBetween(Window.unboundedPreceding, 0)
    return x.select(*by, "bin", F.sum("share").over(w).alias("at_most_share"))


def equal_probability_bins(df: DataFrame, attr: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the n - 1 inner boundaries of n bins of equal probability (exact percentiles; no task holds a group)."""
    x = exact_percentiles(df, list(keys), attr, [i / n for i in range(1, n)])
    return x.select(*keys, F.array(*[f"p{i}" for i in range(n - 1)]).alias("boundaries"))


def percentile_index(value: Column, boundaries: Column) -> Column:
    """The number of boundaries at or below the value."""
    return F.size(F.filter(boundaries, lambda b: b <= value))


# Categorical


def categorical_distribution(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), cond: str | None = None, global_row: bool = False) -> DataFrame:
    """keys, attr, value, count, share. ``cond``: within each of its values; ``global_row``: also over all keys together, keys "*"."""
    by = [*keys, *([cond] if cond else [])]
    cells = unpivot(df, attrs, by, "string").where("value is not null")
    counts = cells.groupBy(*by, "attr", "value").agg(F.count("*").alias("count"))
    if global_row and keys:
        rest = [c for c in (cond, "attr", "value") if c]
        whole = counts.groupBy(*rest).agg(F.sum("count").alias("count")).select(*[F.lit("*").alias(k) for k in keys], *rest, "count")
        counts = counts.select(*[F.col(k).cast("string").alias(k) for k in keys], *rest, "count").unionByName(whole)
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by, "attr")))


def categorical_summary(distribution: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: count, mode (ties: the least value), entropy (ln), Gini index."""
    p = F.col("share")
    return distribution.groupBy(*by).agg(
        F.sum("count").alias("count"), F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"), (-F.sum(p * F.log(p))).alias("entropy"), (1 - F.sum(p * p)).alias("gini")
    )


def confidence_set(distribution: DataFrame, by: Sequence[str], percent: float) -> DataFrame:
    """The most frequent values of each group that together reach ``percent``."""
    w = Window.partitionBy(*by).orderBy(F.col("count").desc(), "value").rowsBetween(Window.unboundedPreceding, -1)
    return distribution.withColumn("_b", F.coalesce(F.sum("share").over(w), F.lit(0.0))).where(F.col("_b") < percent / 100).drop("_b")


def class_distribution(df: DataFrame, attrs: Sequence[str], class_attr: str) -> DataFrame:
    """attr, value, class, count."""
    return unpivot(df, attrs, [F.col(class_attr).alias("class")], "string").groupBy("attr", "value", "class").agg(F.count("*").alias("count"))


def value_difference(df: DataFrame, attrs: Sequence[str], class_attr: str, power: int = 1) -> DataFrame:
    """attr, value1 < value2, distance: sum over the classes of |p(class | value1) - p(class | value2)| ** power.

    Pairs are those of the distinct values, joined per attribute and class; classes that only one value has add its share.
    """
    c = class_distribution(df.dropna(subset=[*attrs, class_attr]), attrs, class_attr)
    c = c.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("attr", "value"))).select("attr", "value", "class", "p")
    values = c.select("attr", "value").distinct()
    pairs = values.withColumnRenamed("value", "value1").join(values.withColumnRenamed("value", "value2"), "attr").where("value1 < value2")
    sides = pairs.join(c.withColumnRenamed("value", "value1"), ["attr", "value1"]).select("attr", "value1", "value2", "class", F.col("p").alias("a"), F.lit(0.0).alias("b")).unionByName(
        pairs.join(c.withColumnRenamed("value", "value2"), ["attr", "value2"]).select("attr", "value1", "value2", "class", F.lit(0.0).alias("a"), F.col("p").alias("b"))
    )
    x = sides.groupBy("attr", "value1", "value2", "class").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return x.groupBy("attr", "value1", "value2").agg(F.sum(F.pow(F.abs(F.col("a") - F.col("b")), F.lit(float(power)))).alias("distance"))


# Tests of fit


def _beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, bin, a, b: two histograms' counts beside each other; b is over all groups of a if it lacks the columns."""
    on = [c for c in by if c in b.columns]
    x = a.select(*by, "bin", F.col("count").alias("a"))
    y = b.select(*on, "bin", F.col("count").alias("b"))
    if set(on) != set(by):
        y = a.select(*by).distinct().join(y, on) if on else a.select(*by).distinct().join(broadcast_if_small(y))  # the bins of one histogram
    return x.join(y, [*by, "bin"], "full").na.fill(0, ["a", "b"])


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the largest difference of the cumulative shares."""
    x, group = _beside(a, b, by), Window.partitionBy(*by)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = F.sum("a").over(upto) / F.sum("a").over(group) - F.sum("b").over(upto) / F.sum("b").over(group)
    return x.withColumn("_d", F.abs(d)).groupBy(*by).agg(F.max("_d").alias("ks"))


def kullback_leibler(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group sum p ln(p / q) / sum p over the bins of both; 0 if fewer than half of a's bins are in b."""
    x, group = _beside(a, b, by), Window.partitionBy(*by)
    x = x.withColumn("p", F.col("a") / F.sum("a").over(group)).withColumn("q", F.col("b") / F.sum("b").over(group))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    s = x.groupBy(*by).agg(F.sum(F.when(both, F.col("p") * F.log(F.col("p") / F.col("q")))).alias("_k"), F.sum(F.when(both, F.col("p"))).alias("_p"), F.count(F.when(both, 1)).alias("_m"), F.count(F.when(F.col("p") > 0, 1)).alias("_n"))
    return s.select(*by, F.when(F.col("_m") * 2 < F.col("_n"), 0.0).otherwise(F.col("_k") / F.col("_p")).alias("kl"))


def chi_square_critical(df: Column, z: float) -> Column:
    """Wilson and Hilferty's approximation of the critical value for a normal quantile z."""
    k = df.cast("double")
    return k * F.pow(1 - 2 / (9 * k) + z * F.sqrt(2 / (9 * k)), F.lit(3.0))


def normal_quantile(significance: float) -> float:
    """The upper normal quantile of any significance level between 0 and 1."""
    return NormalDist().inv_cdf(1 - significance)


def chi_square_reference(a: DataFrame, b: DataFrame, by: Sequence[str], significance: float = 0.05, less_df: int = 3) -> DataFrame:
    """Per group chi square of a's counts against b's shape; bins that b lacks get 1 on both sides. Degrees: bins - less_df."""
    x = _beside(a, b, by)
    empty = F.col("b") == 0
    x = x.withColumn("a", F.when(empty, F.col("a") + 1).otherwise(F.col("a"))).withColumn("b", F.when(empty, F.lit(1)).otherwise(F.col("b")))
    group = Window.partitionBy(*by)
    x = x.withColumn("_e", F.col("b") * F.sum("a").over(group) / F.sum("b").over(group))
    s = x.groupBy(*by).agg(F.sum(F.pow(F.col("a") - F.col("_e"), F.lit(2.0)) / F.col("_e")).alias("chi_square"), F.count("*").alias("_k"))
    return _judged(s, by, significance, less_df)


def chi_square_normal(hist: DataFrame, by: Sequence[str], significance: float = 0.05, less_df: int = 3, mean: float | None = None, std_dev: float | None = None) -> DataFrame:
    """Per group chi square of the counts against a normal distribution: of the given mean and standard deviation, or of
    the group's own where they are not given."""
    group = Window.partitionBy(*by)
    n = F.sum("count").over(group)
    own = F.sum("sum").over(group) / n
    sd = F.sqrt((F.sum("sum_sq").over(group) - n * own * own) / (n - 1)) if std_dev is None else F.lit(float(std_dev))
    mean = own if mean is None else F.lit(float(mean))
    x = hist.withColumn("_n", n).withColumn("_m", mean).withColumn("_s", sd)
    lo, hi = [(F.when(F.col("bin") + k != 0 if k == 0 else F.lit(True), (F.col("bin") + k) * F.col("width")).otherwise(F.lit(0.0)) - F.col("_m")) / F.col("_s") for k in (0, 1)]
    x = x.withColumn("_e", F.greatest(F.col("_n") * (normal_cdf(hi) - normal_cdf(lo)), F.lit(1e-9)))
    s = x.groupBy(*by).agg(F.sum(F.pow(F.col("count") - F.col("_e"), F.lit(2.0)) / F.col("_e")).alias("chi_square"), F.count("*").alias("_k"))
    return _judged(s, by, significance, less_df)


def _judged(s: DataFrame, by: Sequence[str], significance: float, less_df: int) -> DataFrame:
    degrees = F.greatest(F.col("_k") - less_df, F.lit(1))
    critical = chi_square_critical(degrees, normal_quantile(significance))
    return s.select(*by, "chi_square", degrees.cast("int").alias("degrees"), critical.alias("critical"), (F.col("chi_square") < critical).alias("fitted"))


def normal_cdf(z: Column) -> Column:
    """By Abramowitz and Stegun's 26.2.17, to 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def sliding_histogram(df: DataFrame, keys: Sequence[str], seq: str, attr: str, width: float, window: int) -> DataFrame:
    """Per row the histogram (bin -> count) of the last ``window`` rows of its key."""
    o = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-(window - 1), 0)
    bins = F.collect_list(bin_of(F.col(attr), width)).over(o)
    each = F.transform(F.array_sort(F.array_distinct(F.col("_b"))), lambda v: F.struct(v.alias("bin"), F.size(F.filter("_b", lambda x: x == v)).alias("count")))
    return df.withColumn("_b", bins).withColumn("histogram", each).drop("_b")
