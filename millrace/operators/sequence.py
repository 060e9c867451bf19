"""Events in time order per key: intervals, gaps, first and last, and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.season import season_index
from millrace.functions.transform import UNIT_MS


def _order(keys: Sequence[str], ts: str, tie: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(ts, *tie)


def number(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), output: str = "seq") -> DataFrame:
    """Numbers from 1 in time order within each key."""
    return df.withColumn(output, F.row_number().over(_order(keys, ts, tie)))


def time_interval(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), keep_ts: bool = False, output: str = "interval") -> DataFrame:
    """Time since the key's row before, in place of (or beside) the time; first rows are dropped."""
    x = df.withColumn(output, F.col(ts) - F.lag(ts).over(_order(keys, ts, tie))).where(F.col(output).isNotNull())
    return x if keep_ts else x.drop(ts)


def time_gap(df: DataFrame, keys: Sequence[str], ts: str, unit: str, tie: Sequence[str] = (), output: str = "gap") -> DataFrame:
    """Whole ``unit``s (rounded) since the event before; ``ts`` in epoch ms; first events are dropped."""
    gap = (F.col(ts) - F.lag(ts).over(_order(keys, ts, tie))) / UNIT_MS[unit]
    return df.withColumn(output, F.floor(gap + 0.5).cast("long")).where(F.col(output).isNotNull())


def event_gap(df: DataFrame, keys: Sequence[str], ts: str, event: str, first: str, second: str, unit: str) -> DataFrame:
    """Per key the time from the first ``first`` event to the first ``second`` event after it; keys without both give none."""
    start = df.where(F.col(event) == first).groupBy(*keys).agg(F.min(ts).alias("begin"))
    x = df.where(F.col(event) == second).join(start, list(keys)).where(F.col(ts) > F.col("begin"))
    x = x.groupBy(*keys).agg(F.min(ts).alias("end"), F.first("begin").alias("begin"))
    return x.select(*keys, "begin", "end", F.floor((F.col("end") - F.col("begin")) / UNIT_MS[unit] + 0.5).cast("long").alias("gap"))


def sequence_filter(df: DataFrame, keys: Sequence[str], ts: str, how: str, lo=None, hi=None, tie: Sequence[str] = (), compact: str | None = None) -> DataFrame:
    """earliest, latest, range (lo < ts < hi) or none, in time order; ``compact``: one row per key with an array of that field."""
    if how == "range":
        x = df.where((F.col(ts) > lo) & (F.col(ts) < hi))
    elif how in ("earliest", "latest"):
        order = [F.col(c).asc() if how == "earliest" else F.col(c).desc() for c in (ts, *tie)]
        x = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    else:
        x = df
    if compact is None:
        return x
    rows = F.array_sort(F.collect_list(F.struct(ts, *tie, F.col(compact).alias("_value"))))
    return x.groupBy(*keys).agg(F.transform(rows, lambda r: r["_value"]).alias("sequence"))


def temporal_filter(df: DataFrame, seconds: Column, cycle: str, **options) -> DataFrame:
    """Rows inside a season cycle."""
    return df.where(season_index(seconds, cycle, **options) >= 0)
