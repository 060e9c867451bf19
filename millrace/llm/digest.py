"""Percentiles of very large numeric columns from mergeable dyadic-tree digests.

Values are quantized to the 2^64 codes of an ordered universe: a long is its own code, a double is coded by its bits so
that codes have the order of the values. Nothing is clipped or floored, so the leaves are exact. The codes are the leaves
of a dyadic tree whose nodes carry counts; a node is (height, code): the 2^height codes from ``code`` on. A digest of n
values keeps a node apart from its parent only if the node, its sibling and its parent together hold more than n / k:
smaller ones are moved up to the parent. A count moved up loses its place within its node's range only, so the rank of
any value is wrong by at most (BITS + 1) * n / k, whatever the values or their order: with k = (BITS + 1) / error, by
error * n. No inner node ever holds more than n / k, so compressing again does not add to the bound.

Digests merge by adding the counts of equal nodes; inner nodes of the parts hold n_i / k each at most, so those of the
whole hold n / k and the bound stays. Each task builds digests of the rows it reads, one per group, and adds up those of
its groups again after every merge. A merge of the digests of many tasks goes by (group, salt) first and by group then; both
run over nodes in order of the group and compress as they read, so a task holds one digest and a buffer, however many
nodes a hot group has, and the nodes that reach a group's last task are bounded by the salts, not the tasks.

Null values and NaN are left out; infinite values count, at the ends; -0.0 is 0.0. A null group is a group. Groups without
values give no row. Ties and repeated rows count as often as they occur. Decimals are taken as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType

#: Bits of the universe.
BITS = 64
#: Tasks whose digests of one group a task of a merge is meant to read; beyond it a merge goes by (group, salt) first.
FAN_IN = 64
#: Nodes a task holds before it compresses, or hands on, what it has.
BUFFER = 1_000_000

_SIGN = np.uint64(1 << 63)
_LOW = np.uint64((1 << 63) - 1)
_TYPES = ("bigint", "double")


def codes(values: np.ndarray) -> np.ndarray:
    """Codes (as signed integers, in the order of the values) of longs or doubles."""
    if values.dtype.kind != "f":
        return values.astype(np.int64)
    bits = (values.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, bits ^ _LOW, bits).view(np.int64)


def values_of(signed: np.ndarray, kind: str) -> np.ndarray:
    """The values of signed codes; codes beyond the infinities are held at them."""
    if kind == "bigint":
        return signed
    lo, hi = codes(np.array([-np.inf, np.inf]))
    bits = np.clip(signed, lo, hi).view(np.uint64)
    return np.where(bits & _SIGN, bits ^ _LOW, bits).view(np.float64)


def _grouped(height: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order of their lower end, outer ones first, equal ones added up."""
    order = np.lexsort((-height, low))
    height, low, counts = height[order], low[order], counts[order]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (height[1:] != height[:-1])])
    return height[first], low[first], np.add.reduceat(counts, first) if len(first) else counts


def compress(height: np.ndarray, node: np.ndarray, counts: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds up equal nodes and moves families of at most n / k up to their parents, level by level from the leaves.

    A node without sibling or parent goes up as far as it stays alone, so only places where nodes meet need work.
    """
    h, low, c = _grouped(height.astype(np.int64), node.view(np.uint64) ^ _SIGN, counts)
    limit = c.sum() / k if len(c) else 0
    if limit < 1:
        return h, (low ^ _SIGN).view(np.int64), c
    kept = []
    for at in range(1, BITS + 1):
        key = low >> np.uint64(at) if at < BITS else np.zeros(len(low), np.uint64)
        joined = (key[1:] == key[:-1]) & (h[1:] <= at) & (h[:-1] <= at)
        if not joined.any() and at > 1:
            continue
        first = np.flatnonzero(np.r_[True, ~joined])
        size = np.diff(np.r_[first, len(h)])
        together = np.add.reduceat(c, first)
        up = (size > 1) & (together <= limit)
        stay = np.repeat(together > limit, size) & (h < at)  # children that are too large together; their parent goes on
        kept.append((np.full(stay.sum(), at - 1), low[stay] & _mask(at - 1), c[stay]))
        h[first[up]], c[first[up]] = at, together[up]
        low[first[up]] &= _mask(at)
        rest = ~stay
        rest[np.setdiff1d(np.flatnonzero(np.repeat(up, size)), first[up], assume_unique=True)] = False
        h, low, c = h[rest], low[rest], c[rest]
    kept.append((np.full(len(h), BITS), np.zeros(len(h), np.uint64), c))
    h, low, c = (np.concatenate(x) for x in zip(*kept, strict=True))
    return h, (low ^ _SIGN).view(np.int64), c


def _mask(height: int) -> np.uint64:
    return np.uint64(0) if height >= BITS else np.uint64((1 << 64) - (1 << height))


def quantiles(height: np.ndarray, node: np.ndarray, counts: np.ndarray, shares: list[float], kind: str = "bigint") -> np.ndarray:
    """Values whose ranks are within the digest's bound of share * n: nodes in order of their upper ends, small ones first."""
    upper = ((node.view(np.uint64) ^ _SIGN) | ~np.array([_mask(int(x)) for x in range(BITS + 1)], np.uint64)[height]) ^ _SIGN
    upper = upper.view(np.int64)
    order = np.lexsort((height, upper))
    cumulated = np.cumsum(counts[order])
    ranks = np.maximum(1, np.ceil(np.array(shares) * cumulated[-1]))
    return values_of(upper[order][np.minimum(np.searchsorted(cumulated, ranks), len(order) - 1)], kind)


class _Held:
    """Digests of groups, compressed as they grow."""

    def __init__(self, k: float):
        self.k, self.parts, self.loose, self.size = k, {}, {}, 0

    def add(self, key: tuple, nodes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.parts.setdefault(key, []).append(nodes)
        self.loose[key] = self.loose.get(key, 0) + len(nodes[0])
        self.size += len(nodes[0])
        if self.loose[key] > BUFFER:
            self.settle(key)

    def settle(self, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self.parts[key]
        before = sum(len(p[0]) for p in parts)
        one = compress(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.k)
        self.parts[key], self.loose[key] = [one], 0
        self.size -= before - len(one[0])
        return one

    def drain(self) -> Iterator[tuple[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        for key in list(self.parts):
            yield key, self.settle(key)
        self.__init__(self.k)


_NAN = float("nan")


def _runs(columns: list[pa.Array], rows: int, ordered: bool) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row numbers) of the rows of each key of a batch; ``ordered``: in the order of the rows, which has keys together."""
    code = np.zeros(rows, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(), return_inverse=True)[1]
    order = np.arange(rows) if ordered else np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if rows else []
    for i, lo in enumerate(first):
        at = order[lo : first[i + 1] if i + 1 < len(first) else rows]
        key = (c[int(at[0])].as_py() for c in columns)
        yield tuple(_NAN if isinstance(x, float) and x != x else x for x in key), at


def _emit(groups: Iterator, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of about 64,000 nodes, however many small groups they take."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        sizes = [len(g[1][0]) for g in held]
        columns = [pa.array([g[0][i] for g in held], t).take(pa.array(np.repeat(np.arange(len(held)), sizes))) for i, t in enumerate(types)]
        h, low, c = (np.concatenate(x) for x in zip(*[g[1] for g in held], strict=True))
        return pa.RecordBatch.from_arrays([*columns, pa.array(h.astype(np.int32)), pa.array(low), pa.array(c)], names=[*names, "height", "node", "n"])

    for g in groups:
        held.append(g)
        size += len(g[1][0])
        if size > 64_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _adder(keys: int, types: list[pa.DataType], names: list[str], k: float, ordered: bool):
    """Adds up digest nodes of equal keys in a task. ``ordered``: the task's rows are in order of the keys, so each can be
    handed on when the next begins; else what is held is handed on whenever there are more than BUFFER nodes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(k)

        def groups() -> Iterator:
            last = None
            for b in batches:
                h, low, c = (b.column(keys + i).to_numpy() for i in range(3))
                for key, rows in _runs(b.columns[:keys], b.num_rows, ordered):
                    if ordered and key != last and last in held.parts:
                        yield last, held.settle(last)
                        held.size -= len(held.parts.pop(last)[0][0])
                    last = key
                    held.add(key, (h[rows], low[rows], c[rows]))
                if not ordered and held.size > BUFFER:
                    yield from held.drain()
            yield from held.drain()

        yield from _emit(groups(), types, names)

    return run


def _reader(keys: int, types: list[pa.DataType], names: list[str], k: float):
    """Digests of the values a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(k)

        def groups() -> Iterator:
            pending: list[pa.RecordBatch] = []
            rows = 0

            def absorb() -> None:
                v = codes(np.concatenate([b.column(keys).to_numpy() for b in pending]))
                columns = [pa.concat_arrays([b.column(i) for b in pending]) for i in range(keys)]
                for key, at in _runs(columns, len(v), False):
                    own, counts = np.unique(v[at], return_counts=True)
                    held.add(key, (np.zeros(len(own), np.int64), own, counts.astype(np.int64)))

            for b in batches:
                pending.append(b)
                rows += b.num_rows
                if rows >= BUFFER // 4:
                    absorb()
                    pending, rows = [], 0
                    if held.size > 4 * BUFFER:
                        yield from held.drain()
            if rows:
                absorb()
            yield from held.drain()

        yield from _emit(groups(), types, names)

    return run


def digests(df: DataFrame, keys: dict[str, Column], value: Column, error: float = 0.01) -> DataFrame:
    """Digest nodes per group: the keys, height, node, n. Any union of such rows over days or partitions is again a digest.

    Whole and decimal numbers only. Nodes of long values are to be read as bigint, of all others as double: see ``value_kind``.
    """
    names = list(keys)
    source = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("_v")).where("_v is not null")
    kind = _kind(source)
    source = source.withColumn("_v", F.col("_v").cast(kind))
    if kind == "double":
        source = source.where("not isnan(_v)")
    schema = source.drop("_v").schema.add("height", IntegerType()).add("node", LongType()).add("n", LongType())
    types = [to_arrow_type(f.dataType) for f in schema.fields[: len(names)]]
    nodes = source.mapInArrow(_reader(len(names), types, names, (BITS + 1) / error), schema)
    scan = source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return _shuffled(nodes, names, error, int(scan) // int(split))


def value_kind(df: DataFrame, value: Column) -> str:
    """The kind of number that the digests of a column hold: bigint or double."""
    return _kind(df.select(value.alias("_v")))


def _kind(source: DataFrame) -> str:
    name = dict(source.dtypes)["_v"]
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    if name in ("float", "double") or name.startswith("decimal"):
        return "double"
    raise TypeError(f"no numbers: {name}")


def _types(nodes: DataFrame, names: list[str]) -> list[pa.DataType]:
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    return [to_arrow_type(kinds[n]) for n in names]


def _shuffled(nodes: DataFrame, names: list[str], error: float, tasks: int) -> DataFrame:
    """One digest per group, in a sweep over sorted nodes: by (group, salt) first if there are many tasks, then by group."""
    x, k = nodes.select(*names, "height", "node", "n"), (BITS + 1) / error
    schema, types = x.schema, _types(nodes, names)
    salts = min(-(-tasks // FAN_IN), FAN_IN * FAN_IN)
    rounds = [names]
    if salts > 1:
        x = x.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(salts)))
        rounds = [[*names, "_s"], names]
    for by in rounds:
        x = x.repartition(*by).sortWithinPartitions(*by).select(*names, "height", "node", "n").mapInArrow(_adder(len(names), types, names, k, True), schema)
    return x


def merge(nodes: DataFrame, keys: dict[str, Column], error: float = 0.01) -> DataFrame:
    """Digests of coarser groups (weeks of days, all plans ...) by node addition, in the tasks first."""
    x = nodes.select(*[c.alias(k) for k, c in keys.items()], "height", "node", "n")
    names = list(keys)
    x = x.mapInArrow(_adder(len(names), _types(x, names), names, (BITS + 1) / error, False), x.schema)
    return _shuffled(x, names, error, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def percentiles(nodes: DataFrame, keys: list[str], shares: list[float], error: float = 0.01, kind: str = "bigint") -> DataFrame:
    """keys, n, share, value, max_rank_error: the value whose rank is within error * n of share * n.

    ``nodes``: digests of these keys, as ``digests`` and ``merge`` give them (a group's nodes in one task, together).
    """
    if kind not in _TYPES:
        raise ValueError(f"{kind} is none of {_TYPES}")
    x = nodes.select(*keys, "height", "node", "n")
    types = _types(x, keys)
    fields = x.select(*keys).schema.add("n", LongType())
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields.fields], "share double", f"value {kind}", "max_rank_error bigint"])
    number = pa.int64() if kind == "bigint" else pa.float64()

    def rows(head: list[tuple], ns: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
        m = len(shares)
        columns = [pa.array([h[i] for h in head for _ in range(m)], t) for i, t in enumerate(types)]
        n = np.repeat(np.array(ns, np.int64), m)
        columns += [pa.array(n), pa.array(list(shares) * len(head), pa.float64()), pa.array(np.concatenate(values), number), pa.array(np.floor(error * n).astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "share", "value", "max_rank_error"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        head, ns, values = [], [], []

        def close() -> None:
            h, low, c = (np.concatenate(x) for x in zip(*held, strict=True))
            head.append(last)
            ns.append(int(c.sum()))
            values.append(quantiles(h, low, c, shares, kind))

        for b in batches:
            h, low, c = (b.column(len(keys) + i).to_numpy() for i in range(3))
            for key, at in _runs(b.columns[: len(keys)], b.num_rows, True):
                if held and key != last:
                    close()
                    held = []
                last = key
                held.append((h[at].astype(np.int64), low[at], c[at]))
            if len(head) > 5_000:
                yield rows(head, ns, values)
                head, ns, values = [], [], []
        if held:
            close()
        if head:
            yield rows(head, ns, values)

    return x.mapInArrow(read, out)
