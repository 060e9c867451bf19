"""Helpers shared by the operators: checkpoints, checked broadcasts, time and text normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a local session without one (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    sc.setCheckpointDir(folder)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (shared folder, survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a parquet table in the shared checkpoint folder: columnar, so far smaller than a checkpoint
    where values repeat; later reads take only the columns they need, and Spark knows its size when it plans joins. The
    table stays until ``drop_written`` or until the folder is emptied."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Remove the tables that ``written`` has made in this process; call it when their results have been used."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(hadoop).delete(path, True)
    return n


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000, max_chars: int = 10_000_000) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows of ``max_chars`` characters in all as text, else leave
    the join to Spark.

    The check fetches no more than max_rows + 1 rows; what it fetched is what is broadcast.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows or sum(len(str(r)) for r in rows) > max_chars:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a timestamp column; a timestamp without zone is read as UTC in any session zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        t = c.cast("timestamp")
        if zone not in ("UTC", "Etc/UTC", "Z", "GMT"):
            t = F.to_utc_timestamp(t, zone)
        return F.unix_millis(t)
    return F.unix_millis(c.cast("timestamp"))


def spelled(c: Column) -> Column:
    """Identifier spelling: upper case, without outer blanks."""
    return F.upper(F.trim(c))


def floor_div(c: Column, width: int) -> Column:
    """Exact integer floor division, also below zero."""
    return ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("long")


def round_double(c: Column, digits: int) -> Column:
    """``F.round`` of a double column, equal to the bit. That goes through decimal text for each value; here only values
    near a tie, very large ones and those that are no numbers do, all others are divided from the nearest whole number."""
    unit = float(10**digits)
    y = c * F.lit(unit)
    plain = (F.abs(y) < 2.0**40) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.floor(y + 0.5) / F.lit(unit)).otherwise(F.round(c, digits))
