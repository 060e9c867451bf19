"""Streaming sources: directories, sockets and Kafka topics, as (key, value) of text where they have keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def directory(spark: SparkSession, path: str, schema: T.StructType | str | None = None, format: str = "text", max_files: int | None = None) -> DataFrame:
    """New files of a directory."""
    r = spark.readStream.format(format)
    r = r.schema(schema) if schema is not None else r
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r
    return r.load(path)


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka(spark: SparkSession, brokers: str, topic: str, starting: str = "latest", **options: str) -> DataFrame:
    """key and value as text. Needs the Kafka connector on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", starting)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def keyed(df: DataFrame, column: str, key_ordinals: list[int], delim: str = ",") -> DataFrame:
    """Adds key: the joined key fields of a delimited value."""
    parts = F.split(column, f"\\Q{delim}\\E", -1)
    return df.withColumn("key", F.concat_ws(delim, *[F.get(parts, F.lit(i)) for i in key_ordinals]))
