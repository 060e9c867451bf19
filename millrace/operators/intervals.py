"""Overlapping and gapped time intervals as compressed run bitmaps.

Time is discretised to whole units (milliseconds here); an interval sets the bits [start, end). A bitmap is held
per entity and time shard, and only its runs of set bits are stored, one row a run: (entity, shard, run_start,
run_end). Runs are cut at shard borders, so one shard's bitmap depends on nothing outside it: it has at most
``shard`` bits however many intervals an entity has, which bounds every group, and a busy entity spreads over
its shards. The union of bitmaps is taken in two steps: runs starting at the same bit are merged with partial
aggregation before the shuffle (copies vanish there), then a sweep in start order joins those that overlap or touch.
An interval of more than ``long_shards`` shards (an absurd end, say) is not spelt out: the full shards between its two
ends are held as one run over all of them, in place of whatever else lies in these shards.

Rows whose entity, start or end is null and rows whose end is not after the start set no bit and are left out.
An entity without bits gives no row. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import floor_div

#: Six hours of milliseconds.
SHARD = 6 * 3_600_000
#: A hundred days of shards.
LONG_SHARDS = 400


def run_bitmaps(df: DataFrame, entity: Column, start: Column, end: Column, shard: int = SHARD, long_shards: int = LONG_SHARDS) -> DataFrame:
    """The united bitmap of every entity and shard: entity, shard, run_start, run_end (absolute units)."""
    spans = df.select(entity.alias("entity"), start.cast("long").alias("s"), end.cast("long").alias("e"))
    spans = spans.where("entity is not null and s is not null and e is not null and e > s")
    first, last = floor_div(F.col("s"), shard), floor_div(F.col("e") - 1, shard)
    spans = spans.withColumn("first", first).withColumn("last", last)
    is_long = F.col("last") - F.col("first") > long_shards
    some_long = bool(spans.where(is_long).limit(1).collect())
    shards = F.when(is_long, F.array("first", "last")).otherwise(F.sequence("first", "last")) if some_long else F.sequence("first", "last")
    cells = spans.select("entity", "s", "e", F.explode(shards).alias("shard"))
    cells = cells.select(
        "entity",
        "shard",
        F.greatest("s", F.col("shard") * shard).alias("s"),
        F.least("e", (F.col("shard") + 1) * shard).alias("e"),
    )
    runs = cells.groupBy("entity", "shard", "s").agg(F.max("e").alias("e")).repartition("entity", "shard")
    w = Window.partitionBy("entity", "shard").orderBy("s")
    reached = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("opens", F.when(reached.isNull() | (F.col("s") > reached), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("entity", "shard", "run").agg(F.min("s").alias("run_start"), F.max("e").alias("run_end"))
    runs = runs.drop("run")
    if not some_long:
        return runs
    full = spans.where(is_long).groupBy("entity", (F.col("first") + 1).alias("lo")).agg((F.max("last") - 1).alias("hi"))  # a row per shard at most
    w = Window.partitionBy("entity").orderBy("lo")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("opens", F.when(F.col("lo") <= reached + 1, 0).otherwise(1))
    full = full.withColumn("range", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    full = full.groupBy("entity", "range").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r = full.select(F.col("entity").alias("_e"), "lo", "hi")
    free = runs.join(r, (F.col("entity") == F.col("_e")) & F.col("shard").between(F.col("lo"), F.col("hi")), "left_anti")
    return free.unionByName(full.select("entity", F.col("lo").alias("shard"), (F.col("lo") * shard).alias("run_start"), ((F.col("hi") + 1) * shard).alias("run_end")))


def clear_runs(bitmaps: DataFrame) -> DataFrame:
    """The gaps: maximal runs of clear bits between an entity's first and last set bit (entity, gap_start, gap_end).

    Gaps within a shard come from the shard alone. For those across borders only the first and last run of each
    shard take part, two rows a shard at most.
    """
    w = Window.partitionBy("entity", "shard").orderBy("run_start")
    runs = bitmaps.withColumn("next", F.lead("run_start").over(w)).withColumn("before", F.lag("run_end").over(w))
    inner = runs.where("next is not null").select("entity", F.col("run_end").alias("gap_start"), F.col("next").alias("gap_end"))
    edges = runs.where("next is null or before is null").select("entity", "run_start", "run_end", F.col("next").isNull().alias("last"))
    edges = edges.withColumn("next", F.lead("run_start").over(Window.partitionBy("entity").orderBy("run_start")))
    outer = edges.where("last and next > run_end").select("entity", F.col("run_end").alias("gap_start"), F.col("next").alias("gap_end"))
    return inner.unionAll(outer)


def set_runs(bitmaps: DataFrame, shard: int = SHARD) -> DataFrame:
    """The continuous periods: maximal runs of set bits (entity, period_start, period_end).

    Runs inside a shard are final; only runs that touch a shard's border, two a shard at most, are joined across it.
    """
    at_border = (F.pmod(F.col("run_start"), F.lit(shard)) == 0) | (F.pmod(F.col("run_end"), F.lit(shard)) == 0)
    runs = bitmaps.withColumn("border", at_border)
    inner = runs.where(~F.col("border")).select("entity", F.col("run_start").alias("period_start"), F.col("run_end").alias("period_end"))
    w = Window.partitionBy("entity").orderBy("run_start")
    cut = runs.where("border").withColumn("opens", F.when(F.lag("run_end").over(w) == F.col("run_start"), 0).otherwise(1))
    cut = cut.withColumn("period", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    outer = cut.groupBy("entity", "period").agg(F.min("run_start").alias("period_start"), F.max("run_end").alias("period_end"))
    return inner.unionAll(outer.drop("period"))
