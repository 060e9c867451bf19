"""Rolling totals over trailing periods, kept as a versioned daily state.

The state has a row per entity and day on which some trailing total changes: the day's amount and the totals of every
trailing period. A day's total is yesterday's plus the day's arrivals minus the amount that expires that day; an
amount of day d therefore enters on d and expires on d + length, and the state is the running sum of these changes.
Days in between carry the totals of the last change, so days without activity cost nothing until they are listed.

Late arrivals and corrections come as a further batch of daily amounts. ``advance`` gives the state's next version:
only the affected days, from an entity's earliest correction on to its last plus the longest period, are computed
again and written under the new version; ``current`` reads the newest version of every day.

A window holds one entity's change days, three a day of activity at most, whatever the number of records; records are
pre-aggregated per entity and day. Rows without entity, day or amount are left out. Sums are decimals, so no overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMOUNT = "decimal(38,0)"


def daily_amounts(df: DataFrame, entity: Column, day: Column, amount: Column, ident: Column | None = None, late: Column | None = None) -> DataFrame:
    """entity, day, amount: totals per entity and day; with ``ident``, deliveries of one record count once.

    ``late`` (needs ``ident``): whether a delivery belongs to the second batch; adds batch: 0, or 1 for records of which all
    deliveries are late, whose amounts are apart. Null counts as not late.
    """
    if late is not None:
        d = df.select(entity.alias("entity"), day.cast("date").alias("day"), amount.alias("amount"), ident.alias("ident"), F.coalesce(late, F.lit(False)).cast("int").alias("batch"))
        d = d.where("entity is not null and day is not null and amount is not null")
        d = d.groupBy("ident", "entity", "day").agg(F.max("amount").alias("amount"), F.min("batch").alias("batch"))
        return d.groupBy("entity", "day", "batch").agg(F.sum(F.col("amount").cast("decimal(20,0)")).cast(AMOUNT).alias("amount"))
    d = df.select(entity.alias("entity"), day.cast("date").alias("day"), amount.alias("amount"), *([ident.alias("ident")] if ident is not None else []))
    d = d.where("entity is not null and day is not null and amount is not null")
    if ident is not None:
        d = d.groupBy("ident", "entity", "day").agg(F.max("amount").alias("amount"))
    return d.groupBy("entity", "day").agg(F.sum(F.col("amount").cast("decimal(20,0)")).cast(AMOUNT).alias("amount"))


def _changes(daily: DataFrame, lengths: list[int]) -> DataFrame:
    zero = F.lit(0).cast(AMOUNT)
    enter = F.struct(F.lit(0).alias("after"), F.col("amount").alias("amount"), *[F.col("amount").alias(f"c{n}") for n in lengths])
    leave = [F.struct(F.lit(n).alias("after"), zero.alias("amount"), *[(-F.col("amount") if m == n else zero).cast(AMOUNT).alias(f"c{m}") for m in lengths]) for n in lengths]
    x = daily.select("entity", "day", F.explode(F.array(enter, *leave)).alias("c"))
    x = x.select("entity", F.date_add("day", F.col("c.after")).alias("day"), (F.col("c.after") == 0).alias("active"), "c.amount", *[f"c.c{n}" for n in lengths])
    return x.groupBy("entity", "day").agg(F.max("active").alias("active"), *[F.sum(c).cast(AMOUNT).alias(c) for c in ["amount", *[f"c{n}" for n in lengths]]])


def rolling_state(daily: DataFrame, lengths: list[int], version: int = 1) -> DataFrame:
    """entity, day, active, amount, t<length> ..., version: a row per day on which a trailing total changes.

    ``active``: the day has an amount of its own (0 counts).
    """
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.sum(f"c{n}").over(w).cast(AMOUNT).alias(f"t{n}") for n in lengths]
    return _changes(daily, lengths).select("entity", "day", "active", "amount", *totals, F.lit(version).alias("version"))


def current(state: DataFrame) -> DataFrame:
    """The newest version of every entity and day."""
    w = Window.partitionBy("entity", "day").orderBy(F.col("version").desc())
    state = state.repartition("entity")  # serves what follows by entity as well; an entity has a few rows a day
    return state.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def advance(state: DataFrame, arrivals: DataFrame, lengths: list[int], version: int, newest_only: bool = False) -> DataFrame:
    """The rows of the next version after ``arrivals`` (entity, day, amount; negative amounts correct).

    ``state`` is read twice: write it first. ``newest_only``: it has one version of every day.

    Yesterday's totals of the day before an entity's first affected day carry over; only days up to the last arrival
    plus the longest period are computed again. Entities without arrivals give no rows.
    """
    longest = max(lengths)
    touched = arrivals.groupBy("entity").agg(F.min("day").alias("lo"), F.date_add(F.max("day"), longest).alias("hi"))
    now = (state.repartition("entity") if newest_only else current(state)).drop("version")
    delta = _changes(arrivals, lengths).select("entity", "day", "active", "amount", *[f"c{n}" for n in lengths])
    old = now.join(touched, "entity").where("day between lo and hi").select("entity", "day", "active", "amount", *[F.col(f"t{n}") for n in lengths])
    rows = old.withColumn("kind", F.lit(0)).unionByName(delta.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    before = now.join(touched, "entity").where("day < lo").groupBy("entity").agg(*[F.max_by(f"t{n}", "day").alias(f"b{n}") for n in lengths])
    day = rows.groupBy("entity", "day").agg(
        F.max("active").alias("active"), F.sum("amount").cast(AMOUNT).alias("amount"), *[F.max(f"t{n}").alias(f"t{n}") for n in lengths], *[F.sum(f"c{n}").alias(f"c{n}") for n in lengths]
    ).join(before, "entity", "left")
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(AMOUNT)
    totals = [
        (F.coalesce(F.last(f"t{n}", ignorenulls=True).over(w), F.col(f"b{n}"), zero) + F.coalesce(F.sum(f"c{n}").over(w), zero)).cast(AMOUNT).alias(f"t{n}") for n in lengths
    ]
    return day.select("entity", "day", "active", "amount", *totals, F.lit(version).alias("version"))


def every_day(state: DataFrame, lengths: list[int]) -> DataFrame:
    """entity, day, first_day, t<length> ...: each day from the entity's first to its last active day, idle ones included."""
    w = Window.partitionBy("entity").orderBy("day")
    all_days = Window.partitionBy("entity")
    x = state.withColumn("_next", F.lead("day").over(w))
    x = x.withColumn("first_day", F.min(F.when(F.col("active"), F.col("day"))).over(all_days))
    x = x.withColumn("_last", F.max(F.when(F.col("active"), F.col("day"))).over(all_days)).where("day <= _last")
    until = F.coalesce(F.least(F.date_sub("_next", 1), "_last"), F.col("_last"))
    return x.select("entity", "first_day", *[f"t{n}" for n in lengths], F.explode(F.sequence("day", until)).alias("day"))
