"""Bulk mutation of record sets: snapshots with upserts, deletes and synchronisation, and event logs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Mutated(NamedTuple):
    current: DataFrame
    versions: DataFrame


def bulk_mutate(base: DataFrame, increment: DataFrame, keys: Sequence[str], seq: str, op: str | None = None, sync: str = "partial") -> Mutated:
    """The base after an increment.

    upsert: the row with the latest ``seq`` per key (the increment wins ties). delete: base rows without a key in the
    increment. Neither: synchronisation; "partial" is an upsert, "full" also drops keys that the increment lacks.
    ``versions``: all rows of keys present on both sides, with their version (1 is current) and whether they are current.
    """
    names = base.columns
    both = base.withColumn("_new", F.lit(0)).unionByName(increment.select(*names).withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc_nulls_last(), F.col("_new").desc())
    ranked = both.withColumn("_r", F.row_number().over(w)).withColumn("_sides", F.max("_new").over(Window.partitionBy(*keys)) - F.min("_new").over(Window.partitionBy(*keys)) + 1)
    versions = ranked.where("_sides = 2").select(*names, F.col("_r").alias("version"), (F.col("_r") == 1).alias("is_current"))
    if op == "delete":
        return Mutated(base.join(increment.select(*keys).distinct(), list(keys), "left_anti"), versions)
    latest = ranked.where("_r = 1").select(*names)
    if op is None and sync == "full":
        latest = latest.join(increment.select(*keys).distinct(), list(keys), "left_semi")
    return Mutated(latest, versions)


def apply_event_log(events: DataFrame, keys: Sequence[str], seq: str, op_col: str | None = None, delete_code: str = "D") -> DataFrame:
    """The last event per key by ``seq``, unless it is a delete. Ties of ``seq``: the largest row."""
    names = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("_s"), *names)).alias("_e"))
    x = last.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in names]).select(*events.columns)
    return x if op_col is None else x.where(~F.coalesce(F.col(op_col) == delete_code, F.lit(False)))
