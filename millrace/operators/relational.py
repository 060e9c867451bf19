"""Projection, grouping, ordering, joins, set operations and de-duplication on named columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.missing import is_missing
from millrace.functions.predicates import compile_filter
from millrace.operators.common import broadcast_if_small

AGGREGATES = {
    "count": lambda v: F.count(v), "uniqueCount": F.count_distinct, "sum": F.sum, "average": F.avg, "max": F.max, "min": F.min, "stdDev": F.stddev_pop,
}


def _where(df: DataFrame, text: str | None) -> DataFrame:
    return df if text is None else df.where(compile_filter(df, text))


def project(df: DataFrame, fields: Sequence[str] | None = None, exclude: Sequence[str] | None = None, where: str | None = None, key: str | None = None) -> DataFrame:
    """Chosen columns, or all but the excluded ones; ``key`` comes first."""
    names = [c for c in df.columns if c not in set(exclude or [])] if fields is None else list(fields)
    if key:
        names = [key, *[n for n in names if n != key]]
    return _where(df, where).select(*[f"`{n}`" for n in names])


def group_aggregate(df: DataFrame, keys: Sequence[str], value: str, funcs: Sequence[str], where: str | None = None) -> DataFrame:
    """count uniqueCount sum average max min stdDev (population) of one field, each as <func>_<value>."""
    return _where(df, where).groupBy(*keys).agg(*[AGGREGATES[f](F.col(value)).alias(f"{f}_{value}") for f in funcs])


def group_maxima(grouped: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The largest of every aggregate over all groups."""
    numeric = [c for c, t in grouped.dtypes if c not in keys and (t in ("bigint", "int", "double") or t.startswith("decimal"))]
    return grouped.agg(*[F.max(c).alias(f"max_{c}") for c in numeric])


def order_within(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], fields: Sequence[str], limit: int | None = None, rank: bool = False, compact: bool = False) -> DataFrame:
    """Per key the fields in order: one row each (with its rank in place of them if asked), or one row with an array.

    Ties need a further order column for a stable result. The first ``limit`` rows per key only, if given.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    x = df.withColumn("_rank", F.row_number().over(w))
    x = x if limit is None else x.where(F.col("_rank") <= limit)
    if compact:
        rows = F.array_sort(F.collect_list(F.struct("_rank", *fields)))
        return x.groupBy(*keys).agg(F.transform(rows, lambda r: r[fields[0]] if len(fields) == 1 else F.struct(*[r[f].alias(f) for f in fields])).alias("ordered"))
    return x.select(*keys, F.col("_rank").alias("rank")) if rank else x.select(*keys, *fields)


def sort_by(df: DataFrame, field: str, descending: bool = False, numeric: bool = False, limit: int | None = None, then: Sequence[str] = ()) -> DataFrame:
    """A total order by range partitioning; with a limit, a top-k that never sorts the whole table in one place."""
    c = F.col(field).try_cast("double") if numeric else F.col(field)
    x = df.orderBy(c.desc() if descending else c.asc(), *then)
    return x if limit is None else x.limit(limit)


def secondary_sort(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows of a key together and in order within each partition."""
    x = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return x.sortWithinPartitions(*keys, *order_by)


def is_sorted_within(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """Sanity figures of a secondary sort per partition: rows, and steps down within a key."""
    x = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    w = Window.partitionBy("_part", *keys).orderBy("_at")
    x = x.withColumn("_down", (F.lag(order_by).over(w) > F.col(order_by)).cast("int"))
    return x.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("_down"), F.lit(0)).alias("steps_down"))


def named_set_filter(df: DataFrame, field: str, members: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose field is (or is not) among the keys of a table. A null field is in no set."""
    keys = members.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    return df.join(keys, df[field] == keys["_key"], "left_semi" if keep else "left_anti")


def lookup(df: DataFrame, field: str, table: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """The value a side table has for the field, or the field itself; one row per key is expected. Broadcast only if small."""
    side = broadcast_if_small(table.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("string").alias("_value")))
    x = df.join(side, df[field].cast("string") == F.col("_key"), "left")
    return x.withColumn(output, F.coalesce("_value", F.col(field).cast("string"))).drop("_key", "_value")


def row_column_filter(df: DataFrame, field: str, exclude_rows: DataFrame | None = None, key: str | None = None, exclude_columns: Sequence[str] = ()) -> DataFrame:
    x = df if exclude_rows is None else named_set_filter(df, field, exclude_rows, key or field, keep=False)
    return x.drop(*exclude_columns)


def join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    left_fields: Sequence[str] = (),
    right_fields: Sequence[str] = (),
    left_where: str | None = None,
    right_where: str | None = None,
    left_default=None,
    right_default=None,
    key_position: str = "begin",
) -> DataFrame:
    """Equi-join on composite keys with a filter and a projection on either side before the shuffle.

    A default for the left side keeps unmatched right rows, one for the right side unmatched left rows, both keep both;
    the missing fields take the default (text for text columns, else cast). Keys come first or last as key0, key1, ...
    """
    ln, rn = [f"key{i}" for i in range(len(left_keys))], list(right_fields)
    a = _where(left, left_where).select(*[F.col(k).alias(n) for k, n in zip(left_keys, ln, strict=True)], *[f"`{f}`" for f in left_fields], F.lit(True).alias("_l"))
    b = _where(right, right_where).select(*[F.col(k).alias(n) for k, n in zip(right_keys, ln, strict=True)], *[f"`{f}`" for f in rn], F.lit(True).alias("_r"))
    how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "full"}[(left_default is not None, right_default is not None)]
    x = a.join(b, ln, how)
    kinds = dict(x.dtypes)
    fill = lambda f, flag, d: F.when(F.col(flag).isNull(), F.lit(d).cast(kinds[f])).otherwise(F.col(f)).alias(f)
    fields = [fill(f, "_l", left_default) if left_default is not None else F.col(f) for f in left_fields]
    fields += [fill(f, "_r", right_default) if right_default is not None else F.col(f) for f in rn]
    return x.select(*(ln + fields if key_position == "begin" else fields + ln))


#: Result rows of a piece of a key, least result rows of a key that is cut into pieces, and such keys at most.
PIECE, LEAST, CROWDED = 2_000_000, 100_000, 20_000


def _crowded(parts: Sequence[DataFrame], outer: bool) -> DataFrame:
    """Of keys with many result rows: the part with most rows (``widest``) and the number of ``pieces``."""
    counts = reduce(lambda a, b: a.join(b, "key", "full" if outer else "inner"), [p.groupBy("key").agg(F.count("*").cast("double").alias(f"n{i}")) for i, p in enumerate(parts)])
    ns = [F.coalesce(F.col(f"n{i}"), F.lit(1.0)) for i in range(len(parts))]
    most = reduce(lambda a, b: F.when(a >= b, a).otherwise(b), ns)
    widest = F.coalesce(*[F.when(n == most, i) for i, n in enumerate(ns)])
    x = counts.where(F.col("key").isNotNull()).select("key", widest.alias("widest"), reduce(lambda a, b: a * b, ns).alias("made"))
    x = x.where(F.col("made") >= LEAST).orderBy(F.desc("made")).limit(CROWDED)
    return x.select("key", "widest", F.ceil(F.col("made") / PIECE).cast("int").alias("pieces"))


def multi_join(inputs: Mapping[str, tuple[DataFrame, str, Sequence[str], str | None]], outer: bool = False) -> DataFrame:
    """Several inputs on one key each: name -> (frame, key, fields, filter); fields become <name>_<field>.

    ``outer`` keeps all keys; missing text fields are "", others null. Of a key with many result rows the input with most
    rows is cut into pieces by a hash of its fields; each meets the others' rows of the key in a task of its own.
    """
    parts = [_where(df, w).select(F.col(k).alias("key"), *[F.col(f).alias(f"{n}_{f}") for f in fs]) for n, (df, k, fs, w) in inputs.items()]
    joined = lambda ps: reduce(lambda a, b: a.join(b, "key", "full" if outer else "inner"), ps)
    found = _crowded(parts, outer) if len(parts) > 1 else None
    rows = found.collect() if found is not None else []
    x = joined(parts)
    if rows:
        names, kind = x.columns, found.schema
        table = lambda rs: F.broadcast(found.sparkSession.createDataFrame(rs, kind))
        x = joined([p.join(table(rows).select("key"), "key", "left_anti") for p in parts])
        for i in sorted({r["widest"] for r in rows}):
            own = [r for r in rows if r["widest"] == i]
            tasks = min(sum(r["pieces"] for r in own), 10_000)
            at = [c for c, t in parts[i].dtypes if c != "key" and "map<" not in t and t != "variant"]
            piece = F.pmod(F.xxhash64(*at), F.col("pieces")).cast("int") if at else F.lit(0)
            every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
            spread = [p.join(table(own), "key").withColumn("_piece", piece if j == i else every).drop("widest", "pieces").repartition(tasks, "key", "_piece") for j, p in enumerate(parts)]
            # an inner join's keys are in all inputs, an outer join's in the widest
            y = reduce(lambda a, b: a.join(b.hint("merge"), ["key", "_piece"], "left"), [spread[i], *spread[:i], *spread[i + 1 :]])
            x = x.unionByName(y.select(*names))
    return x.na.fill("", [c for c, t in x.dtypes if t == "string" and c != "key"]) if outer else x


def combinator(df: DataFrame, fields: Sequence[str], key: str | None = None) -> DataFrame:
    """All unordered pairs of a row's fields (the fields bound the pairs), the lesser text first; nulls pair with none."""
    values = [F.col(f).cast("string") for f in fields]
    pairs = [F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")) for i, a in enumerate(values) for b in values[i + 1 :]]
    both = F.filter(F.array(*[F.when(a.isNotNull() & b.isNotNull(), p) for p, (a, b) in zip(pairs, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]], strict=True)]), lambda p: p.isNotNull())
    return df.select(*([key] if key else []), F.inline(both))


def set_op(first: DataFrame, second: DataFrame, op: str, keys: Sequence[str], value: str | None = None, match_by: str = "key", retain: int | None = None) -> DataFrame:
    """intersect, union, firstMinusSecond, secondMinusFirst.

    By key: intersect gives the first's row of keys that occur exactly once on either side; a difference the row of keys
    that occur exactly once, on its side only; union is the bag union. By value: per key the sets of values are compared
    and come as one sorted array, of which ``retain`` are kept (union: half from either side).
    """
    if match_by == "value":
        a = first.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_a"))
        b = second.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_b"))
        x = a.join(b, list(keys), "full")
        none = F.array().cast(dict(a.dtypes)["_a"])
        p, q = F.coalesce("_a", none), F.coalesce("_b", none)
        if op == "union":
            half = None if retain is None else retain // 2
            out = F.concat(p if half is None else F.slice(p, 1, half), q if half is None else F.slice(q, 1, half))
        else:
            out = F.array_sort({"intersect": F.array_intersect(p, q), "firstMinusSecond": F.array_except(p, q), "secondMinusFirst": F.array_except(q, p)}[op])
            out = out if retain is None else F.slice(out, 1, retain)
        return x.select(*keys, out.alias(value)).where(F.size(value) > 0)
    if op == "union":
        return first.unionByName(second)
    if op == "secondMinusFirst":
        return set_op(second, first, "firstMinusSecond", keys)
    sides = first.select(*keys, F.lit(1).alias("_f"), F.lit(0).alias("_s")).unionByName(second.select(*keys, F.lit(0).alias("_f"), F.lit(1).alias("_s")))
    counts = sides.groupBy(*keys).agg(F.sum("_f").alias("_f"), F.sum("_s").alias("_s"))
    return first.join(counts.where(f"_f = 1 and _s = {1 if op == 'intersect' else 0}").select(*keys), list(keys), "left_semi")


class Dedup(NamedTuple):
    result: DataFrame
    members: DataFrame


def dedup(df: DataFrame, keys: Sequence[str] | None = None, mode: str = "all", whole: bool = True, order_by: Sequence[str] | None = None) -> Dedup:
    """all: one row per key; duplicate: one row per key that occurs more than once; unique: rows of keys that occur once.

    ``keys`` default to the whole row; ``order_by`` decides which row stands for its key. Null keys are alike.
    ``members``: all rows of keys that occur more than once. Counting is by partial aggregation, so a key held by a
    third of the rows is no burden, save for the members, which are its rows.
    """
    names = list(keys or df.columns)
    wanted = {"all": "_n >= 1", "duplicate": "_n > 1", "unique": "_n = 1"}[mode]
    rows = whole and set(names) != set(df.columns)
    stands = [F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), F.struct(*(order_by or [f"`{c}`" for c in df.columns]))).alias("_row")] if rows else []
    counted = df.groupBy(*[f"`{c}`" for c in names]).agg(F.count("*").alias("_n"), *stands)
    result = counted.where(wanted).select("_row.*") if rows else counted.where(wanted).select(*[f"`{c}`" for c in names])
    more = df.groupBy(*[f"`{c}`" for c in names]).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)])
    on = reduce(lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(more[f"_k{i}"]) for i, c in enumerate(names)])
    return Dedup(result, df.join(more, on, "left_semi"))


class Split(NamedTuple):
    selected: DataFrame
    remaining: DataFrame


def split(df: DataFrame, how: str, fraction: float = 0.1, seed: int = 100, where: str | None = None, tag: str | None = None, replacement: bool = False) -> Split:
    """subSample, filter or withMissingFields, and what is left. A sample's rows are chosen once by a hash-free random column;
    with replacement there is no remainder, which is then empty."""
    if how == "subSample":
        if replacement:
            return Split(df.sample(True, fraction, seed), df.limit(0))
        x = df.withColumn("_u", F.rand(seed))
        return Split(x.where(F.col("_u") < fraction).drop("_u"), x.where(F.col("_u") >= fraction).drop("_u"))
    if how == "filter":
        c = compile_filter(df, where)
    elif how == "withMissingFields":
        c = reduce(lambda a, b: a | b, [is_missing(F.col(f"`{n}`"), tag) for n in df.columns])
    else:
        raise ValueError(how)
    return Split(df.where(c), df.where(~c))


def range_partition(df: DataFrame, field: str, n: int | None = None, boundaries: Sequence[float] | None = None, keys: Sequence[str] = (), output: str = "range_index") -> DataFrame:
    """Adds the number of the equal-width range (per key, between its minimum and maximum) or of the range between boundaries."""
    if boundaries is not None:
        index = reduce(lambda a, b: a + b, [(F.col(field) >= b).cast("int") for b in boundaries])
        return df.withColumn(output, index)
    ends = df.groupBy(*keys).agg(F.min(field).cast("double").alias("_lo"), F.max(field).cast("double").alias("_hi"))
    x = df.join(ends, list(keys)) if keys else df.join(F.broadcast(ends))  # one row without keys
    place = F.floor((F.col(field) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * n)
    return x.withColumn(output, F.least(F.coalesce(place, F.lit(0)), F.lit(n - 1)).cast("int")).drop("_lo", "_hi")


def filter_missing_columns(df: DataFrame, percent: int, tag: str | None = None) -> DataFrame:
    """Without the columns of which more than rows * percent / 100 (whole division) values are missing. Reads one row of counts."""
    counts = df.select(F.count("*").alias("_rows"), *[F.sum(is_missing(F.col(f"`{c}`"), tag).cast("long")).alias(c) for c in df.columns]).collect()[0]
    most = counts["_rows"] * percent // 100
    return df.drop(*[c for c in df.columns if (counts[c] or 0) > most])


def filter_missing_rows(df: DataFrame, most: int, tag: str | None = None) -> DataFrame:
    return df.where(reduce(lambda a, b: a + b, [is_missing(F.col(f"`{c}`"), tag).cast("int") for c in df.columns]) <= most)


def filter_by_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], conditions: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Rows whose key passes all conditions: attr -> {countAbove, meanBelow, ...: threshold}; Above is >=, Below is <.

    ``stats``: keys, attr, and the columns count, mean, std_dev, range, cardinality that are asked for.
    """
    tests = []
    for attr, limits in conditions.items():
        for name, limit in limits.items():
            stat, above = (name[:-5], True) if name.endswith("Above") else (name[:-5], False)
            column = {"stdDev": "std_dev"}.get(stat, stat)
            v = F.max(F.when(F.col("attr") == attr, F.col(column)))
            tests.append(F.coalesce(v >= limit if above else v < limit, F.lit(False)))
    passing = stats.groupBy(*keys).agg(reduce(lambda a, b: a & b, tests).alias("_ok")).where("_ok").select(*keys)
    return df.join(passing, list(keys), "left_semi")


def zscore_filter(df: DataFrame, attrs: Sequence[str], z: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows within mean +- z standard deviations (population) of every attribute, per key if given."""
    s = df.groupBy(*keys).agg(*[f(F.col(a)).alias(f"_{n}_{a}") for a in attrs for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = df.join(s, list(keys)) if keys else df.join(F.broadcast(s))  # one row without keys
    inside = [F.abs(F.col(a) - F.col(f"_m_{a}")) <= z * F.col(f"_s_{a}") for a in attrs]
    return x.where(reduce(lambda a, b: a & b, inside)).select(*df.columns)


def format_key_values(df: DataFrame, groups: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Repeated (key field, value field) groups of a row, regrouped: keys, kv_key, sorted values."""
    pairs = F.array(*[F.struct(F.col(k).cast("string").alias("kv_key"), F.col(v).alias("kv_value")) for k, v in groups])
    return df.select(*keys, F.inline(pairs)).groupBy(*keys, "kv_key").agg(F.array_sort(F.collect_list("kv_value")).alias("kv_values"))
