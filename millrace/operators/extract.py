"""Flat records from JSON and from lines of text by patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Entities(NamedTuple):
    root: DataFrame
    children: dict[str, DataFrame]


def parse_json(df: DataFrame, column: str, schema: str, mode: str = "PERMISSIVE", output: str = "json") -> DataFrame:
    """Adds the parsed struct; bad texts give null (PERMISSIVE) or fail (FAILFAST)."""
    return df.withColumn(output, F.from_json(column, schema, {"mode": mode}))


def extract_flat(df: DataFrame, column: str, paths: Mapping[str, str], keep: Sequence[str] = (), default: str | None = None) -> DataFrame:
    """One row per record: output name -> JSON path ($.a.b[0]); null where absent, or the default."""
    value = lambda p: F.get_json_object(column, p)
    return df.select(*keep, *[(F.coalesce(value(p), F.lit(default)) if default is not None else value(p)).alias(n) for n, p in paths.items()])


def _walk(c: Column, dotted: str) -> Column:
    for part in dotted.split(".") if dotted else []:
        c = c[part]
    return c


def extract_denormalized(df: DataFrame, json: str, lists: Sequence[str], fields: Mapping[str, str], keep: Sequence[str] = (), default: str | None = None, drop_missing: bool = False) -> DataFrame:
    """Rows of the Cartesian product of the nested lists of a parsed struct.

    ``lists``: dotted paths; a path that begins with an earlier one and "[]." is inside its elements. ``fields``: output
    name -> dotted path, likewise. Empty or absent lists give one row with nulls (or defaults), or none with ``drop_missing``.
    """
    x, at = df.withColumn("_0", F.col(json)), {"": "_0"}

    def resolve(path: str) -> Column:
        prefix = max((p for p in at if p == "" or path.startswith(p + "[].")), key=len)
        return _walk(F.col(at[prefix]), path[len(prefix) + 3 :] if prefix else path)

    for i, path in enumerate(lists, 1):
        explode = F.explode if drop_missing else F.explode_outer
        x = x.withColumn(f"_{i}", explode(resolve(path)))
        at[path] = f"_{i}"
    out = [resolve(p).cast("string") for p in fields.values()]
    out = [F.coalesce(c, F.lit(default)) if default is not None else c for c in out]
    x = x.select(*keep, *[c.alias(n) for n, c in zip(fields, out, strict=True)])
    return x.dropna(subset=list(fields)) if drop_missing and default is None else x


def extract_normalized(df: DataFrame, json: str, ident: str, root_fields: Mapping[str, str], children: Mapping[str, tuple[str, Mapping[str, str]]]) -> Entities:
    """A root table and a table per child list, linked by the id; children also have their position.

    ``children``: entity -> (dotted path of the list, output name -> dotted path within an element).
    """
    root = df.select(ident, *[_walk(F.col(json), p).cast("string").alias(n) for n, p in root_fields.items()])
    kids = {}
    for name, (path, fields) in children.items():
        x = df.select(ident, F.posexplode(_walk(F.col(json), path)).alias("pos", "_e"))
        kids[name] = x.select(ident, "pos", *[_walk(F.col("_e"), p).cast("string").alias(n) for n, p in fields.items()])
    return Entities(root, kids)


def extract_regex(df: DataFrame, column: str, pattern: str, names: Sequence[str], keep: Sequence[str] = (), dates: Mapping[str, str] | None = None) -> DataFrame:
    """The groups of a pattern that must match the whole line; other lines are dropped. ``dates``: name -> format, as epoch s."""
    whole = f"^(?:{pattern})$"
    out = []
    for i, n in enumerate(names):
        c = F.regexp_extract(column, whole, i + 1)
        out.append((F.unix_timestamp(F.try_to_timestamp(c, F.lit(dates[n]))) if dates and n in dates else c).alias(n))
    return df.where(F.col(column).rlike(whole)).select(*keep, *out)


def extract_raw(df: DataFrame, column: str, fields: Mapping[str, tuple[str, object]], keep: Sequence[str] = ()) -> DataFrame:
    """Raw fields: name -> ("regex", pattern with one group), ("substring", (from, to)), or ("verbatim", None)."""
    out = []
    for n, (how, arg) in fields.items():
        c = F.col(column)
        if how == "regex":
            c = F.regexp_extract(column, arg, 1)
        elif how == "substring":
            c = F.substring(column, arg[0] + 1, arg[1] - arg[0])
        out.append(c.alias(n))
    return df.select(*keep, *out)


def flatten_multiline(df: DataFrame, line: str, order: str, begin: str, keys: Sequence[str] = (), sep: str = " ") -> DataFrame:
    """Records of several lines: a line that matches ``begin`` opens one, the lines up to the next are joined to it.

    Lines before the first beginning belong to record 0 and are dropped. ``keys``: the files, whose lines stay apart.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("record", F.sum(F.col(line).rlike(begin).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("record > 0")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return x.groupBy(*keys, "record").agg(F.array_join(F.transform(rows, lambda r: r["l"]), sep).alias(line))
