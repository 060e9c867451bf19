"""Delimited text, JSON files and text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import Schema


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | Schema | Sequence[str], sep: str = ",", quote: str | None = '"', trim: bool = True, mode: str = "PERMISSIVE", header: bool = False) -> DataFrame:
    """Delimited text of any Hadoop file system, globs included. Fields are trimmed; empty and absent fields are null.

    A list of names reads all fields as text; a schema reads them typed, and what cannot be read is null (PERMISSIVE),
    its row is dropped (DROPMALFORMED) or fails the query (FAILFAST).
    """
    if isinstance(schema, Schema):
        schema = schema.struct_type()
    elif not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in schema])
    r = spark.read.schema(schema).option("sep", sep).option("mode", mode).option("header", header)
    r = r.option("quote", quote or "").option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
    return r.csv(path if isinstance(path, str) else list(path))


def read_lines(spark: SparkSession, path: str, record_sep: str | None = None, whole: bool = False) -> DataFrame:
    """file_name, value: lines, or whole files."""
    r = spark.read.option("wholetext", whole)
    r = r.option("lineSep", record_sep) if record_sep else r
    return r.text(path).select(F.input_file_name().alias("file_name"), "value")


def split_lines(df: DataFrame, column: str, names: Sequence[str], delim: str = ",", trim: bool = True) -> DataFrame:
    """Lines cut at a delimiter (trailing empty fields kept) to named text columns; missing fields are null."""
    parts = F.split(column, f"\\Q{delim}\\E", -1)
    cut = [F.get(parts, F.lit(i)) for i in range(len(names))]
    return df.select(*[(F.trim(c) if trim else c).alias(n) for c, n in zip(cut, names, strict=True)])


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON lines, or one document a file; the schema is given, never inferred."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", mode).json(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", precision: int | None = None, header: bool = False, partition_by: Sequence[str] = (), max_records: int | None = None) -> None:
    """Delimited text; doubles rounded to ``precision`` here, at the edge, and nowhere else. ``partition_by``: a directory per entity."""
    kinds = dict(df.dtypes)
    out = df if precision is None else df.select(*[F.round(c, precision).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])
    w = out.write.mode("overwrite").option("sep", sep).option("header", header)
    w = w.option("maxRecordsPerFile", max_records) if max_records else w
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_sized(df: DataFrame, path: str, mb: int = 128, row_bytes: int = 200) -> None:
    """Columnar files of about ``mb`` megabytes, by records a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max(1, mb * 1024 * 1024 // row_bytes)).parquet(path)


def file_map(df: DataFrame) -> DataFrame:
    """file_name, rows: which file holds how many rows."""
    return df.select(F.input_file_name().alias("file_name")).groupBy("file_name").agg(F.count("*").alias("rows"))


def show_debug(df: DataFrame, n: int = 20) -> None:
    """The first rows, for debugging."""
    df.show(n, truncate=False)
