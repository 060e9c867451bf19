"""Columnar tables, one parquet path each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; filters and column choice reach the parquet scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
