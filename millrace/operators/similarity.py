"""Records compared within blocks, and the nearest per record."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.functions.distance import Part, TokenMatrix, prepared, record_distance


#: Records of a chunk, and chunks of a block at most.
CHUNK, CHUNKS = 2_000, 1_000
#: Pairs of a task that compares texts, such tasks at most, and pairs of an Arrow batch.
PAIRS, TASKS, BATCH = 500_000, 10_000, 200_000


def block_sizes(df: DataFrame, block: str | None) -> tuple[int, float]:
    """Chunks for the largest block of ``df``, and the sum of squares of the blocks' records."""
    key = F.col(block).cast("string") if block else F.lit("")
    n = F.col("count").cast("double")
    most, squares = df.groupBy(key.alias("_block")).count().agg(F.max("count"), F.sum(n * n)).collect()[0]
    return min(max(1, -(-(most or 0) // CHUNK)), CHUNKS), squares or 0.0


def _compared(parts: Sequence[Part], one: bool, include_self: bool):
    """All pairs of a pair of chunks with the distances of the text ``parts``, for applyInArrow."""

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        named = lambda side, n: pa.table({c: side[f"{c}{n}"] for c in ("id", "r") if f"{c}{n}" in side.column_names} | {c: side[c] for c in side.column_names if c[0] == "w"})
        a, b = (named(rows.filter(pc.equal(rows["side"], n)), n) for n in (1, 2))
        within = one and key[1].as_py() == key[2].as_py()
        if within:
            a = b = a.sort_by("id")
        if not a.num_rows or not b.num_rows:
            return
        n, m = a.num_rows, b.num_rows
        flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        texts = [TokenMatrix(p, flat(a[f"w{k}"]), flat(b[f"w{k}"])) for k, p in enumerate(parts)]
        rank = np.zeros(n + m, np.int64)
        if one:
            rank = pc.rank(pa.chunked_array([*a["id"].chunks, *b["id"].chunks]), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        ra, rb = rank[:n], rank[n:]
        # a record of a pair is in the first, or else in the second chunk
        kept = [c for c in ("id", "r") if c in a.column_names]
        left = {c: flat(pa.chunked_array([*a[c].chunks, *b[c].chunks])) if one else flat(a[c]) for c in kept}
        right = {c: left[c] if one else flat(b[c]) for c in kept}
        step = max(1, BATCH // m)
        for start in range(0, n, step):
            stop = min(start + step, n)
            first = int(np.searchsorted(rb, ra[start])) if within else 0
            i, j = np.repeat(np.arange(start, stop), m - first), np.tile(np.arange(first, m), stop - start)
            shared = [t.shared(start, stop, first).ravel() for t in texts]
            if within:
                at = np.flatnonzero(ra[i] <= rb[j] if include_self else ra[i] < rb[j])
                i, j, shared = i[at], j[at], [s[at] for s in shared]
            turned = ra[i] > rb[j] if one and not within else None
            p, q = i, j + n if one else j
            if turned is not None:
                p, q = np.where(turned, q, p), np.where(turned, p, q)
            p, q = pa.array(p), pa.array(q)
            out = {f"{c}{k}": side[c].take(x) for c in kept for k, side, x in ((1, left, p), (2, right, q))}
            yield pa.RecordBatch.from_pydict(out | {f"t{k}": t.distances(s, i, j, turned) for k, (t, s) in enumerate(zip(texts, shared, strict=True))})

    return pairs


def record_similarity(df: DataFrame, ident: str, parts: Sequence[Part], other: DataFrame | None = None, block: str | None = None, threshold: float | None = None, chunks: int | None = None, scale: float | None = None, include_self: bool = False, how: str = "weighted", missing: float | None = None) -> DataFrame:
    """id1, id2, distance of all pairs of a block (of one set, id1 < id2, or across two), up to ``threshold``.

    A block's pairs are what is asked for; they are spread: every record goes to the chunk pairs its chunk takes part in,
    each a group of its own, with as many chunks as the largest block asks (``chunks`` sets their number). Of one set only
    half of the chunk pairs are made. Texts are cut into tokens once a record, and compared for all pairs of two chunks at
    once, by the product of their term matrices. ``how``: weighted mean of the parts, or an aggregate of them. ``scale``:
    distances as rounded whole numbers. Without a block the whole set is one.
    """
    sizes = [block_sizes(d, block) for d in (df, other) if d is not None]
    chunks = chunks or max(c for c, _ in sizes)
    texts = [i for i, p in enumerate(parts) if p.kind == "text"]
    fields = {p.name: prepared(p) for p in parts if p.kind != "text"}
    key = F.col(block).cast("string") if block else F.lit("")
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")

    def side(d: DataFrame, label: str) -> DataFrame:
        r = [F.struct(*[c.alias(n) for n, c in fields.items()]).alias(f"r{label}")] if fields else []
        words = [prepared(parts[i]).alias(f"w{k}") for k, i in enumerate(texts)]
        return d.select(key.alias("_block"), F.col(ident).alias(f"id{label}"), *r, *words, chunk(F.col(ident)).alias(f"c{label}"))

    a, b = side(df, "1"), side(df if other is None else other, "2")
    last = F.lit(chunks - 1)
    a = a.withColumn("c2", F.explode(F.sequence(F.col("c1") if other is None else F.lit(0), last)))
    b = b.withColumn("c1", F.explode(F.sequence(F.lit(0), F.col("c2") if other is None else last)))
    if texts:
        if other is None:  # a chunk with itself has its records once
            a, b = a.where(F.col("id1").isNotNull()), b.where(F.col("id2").isNotNull() & (F.col("c1") < F.col("c2")))
        squares = [s for _, s in sizes]
        tasks = min(max(1, round((squares[0] * squares[-1]) ** 0.5 / (2 if other is None else 1) / PAIRS)), TASKS)
        x = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)), allowMissingColumns=True)
        given = [f.name for f in x.schema if f.name in ("id1", "id2", "r1", "r2")]
        schema = StructType([x.schema[c] for c in sorted(given)] + [StructField(f"t{k}", DoubleType()) for k in range(len(texts))])
        x = x.where(F.col("_block").isNotNull()).repartition(tasks, "_block", "c1", "c2").groupBy("_block", "c1", "c2").applyInArrow(_compared([parts[i] for i in texts], other is None, include_self), schema)
        d = record_distance("r1", "r2", parts, how, missing, {i: F.col(f"t{k}") for k, i in enumerate(texts)})
        id1, id2 = F.col("id1"), F.col("id2")
    else:
        x = a.join(b, ["_block", "c1", "c2"])
        if other is None:
            x = x.where((F.col("c1") < F.col("c2")) | (F.col("id1") <= F.col("id2") if include_self else F.col("id1") < F.col("id2")))
        d = record_distance("r1", "r2", parts, how, missing)
        id1, id2 = (F.least("id1", "id2"), F.greatest("id1", "id2")) if other is None else (F.col("id1"), F.col("id2"))
    x = x.select(id1.alias("id1"), id2.alias("id2"), (F.floor(d * scale + 0.5).cast("long") if scale else d).alias("distance"))
    return x if threshold is None else x.where(F.col("distance") <= threshold)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from either side."""
    return pairs.select("id1", "id2", "distance").unionAll(pairs.select("id2", "id1", "distance"))


def top_matches(pairs: DataFrame, src: str, trg: str, dist: str, n: int | None = None, max_dist: float | None = None, compact: bool = False) -> DataFrame:
    """Per source the nearest targets, by number and by distance, with their rank; compact: one row with an array."""
    x = pairs if max_dist is None else pairs.where(F.col(dist) <= max_dist)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy(src).orderBy(dist, trg)))
    x = x if n is None else x.where(F.col("rank") <= n)
    if not compact:
        return x.select(src, trg, dist, "rank")
    return x.groupBy(src).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", trg, dist))), lambda r: r[trg]).alias("matches"))
