"""What counts as missing: null, empty, or a given tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(c: Column, tag: str | None = None) -> Column:
    s = c.cast("string")
    out = s.isNull() | (s == "")
    return out if tag is None else out | F.coalesce(s == tag, F.lit(False))


def is_blank(c: Column) -> Column:
    s = c.cast("string")
    return s.isNull() | (F.trim(s) == "")
