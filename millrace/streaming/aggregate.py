"""Streaming aggregates: tumbling windows with watermarks, running statistics, recency weighted state, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.stats import unpivot


def tumbling(stream: DataFrame, keys: Sequence[str], ts: str, attrs: Sequence[str], window: str, delay: str, func: str = "sum") -> DataFrame:
    """count, sum or average per key, tumbling event-time window and attribute; rows later than ``delay`` are left out."""
    f = {"count": F.count, "sum": F.sum, "average": F.avg}[func]
    x = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("value")) for a in attrs])
    x = x.select(*keys, "_ts", F.inline(cells))
    return x.groupBy(*keys, F.window("_ts", window), "attr").agg(f("value").alias(func)).select(*keys, F.col("window.start").alias("bucket"), "attr", func)


def running_stats(stream: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Running count, sum, sum_sq, mean and std_dev per key and attribute, for complete or update mode."""
    x = unpivot(stream, attrs, keys).where("value is not null")
    return x.groupBy(*keys, "attr").agg(
        F.count("value").alias("count"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_dev")
    )


def recency_weighted(stream: DataFrame, key: str, value: str, order: str, step: float) -> DataFrame:
    """key, average, n: avg += step * (v - avg) over each key's values, in the order of ``order`` within a micro-batch.

    The state of a key is two numbers. A key's values of one micro-batch are held, as they must be put in order; the
    micro-batch bounds them.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (0.0, 0)
        values = pd.concat([b[["v", "o"]] for b in batches], ignore_index=True).sort_values("o", kind="stable")["v"]
        for v in values:
            average = float(v) if n == 0 else average + step * (float(v) - average)
            n += 1
        state.update((average, n))
        yield pd.DataFrame({"key": [k[0]], "average": [average], "n": [n]})

    x = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v"), F.col(order).alias("o")).where("v is not null")
    return x.groupBy("key").applyInPandasWithState(update, "key string, average double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, checkpoint: str, mode: str = "append", each_batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None, memory: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a query to a parquet path, an in-memory table or a function of each micro-batch (exactly once by its id)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    if each_batch is not None:
        return w.foreachBatch(each_batch).start()
    if memory is not None:
        return w.format("memory").queryName(memory).start()
    return w.format("parquet").option("path", path).start()


def upsert_into(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the newest row per key, by ``order``, in a directory of batches.

    Of rows of equal order the greatest by the other columns is kept, so a batch that is run again gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, keys, F.struct(F.col(order))).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _newest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.max(F.struct(order.alias("_o"), F.struct(*rest).alias("_r"))).alias("_m"))
    return x.select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in rest])


def newest(batches: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row per key over the batches that ``upsert_into`` wrote: by ``order``, then by batch."""
    return _newest(batches.drop("batch"), keys, F.struct(order, "batch_id")).drop("batch_id")
