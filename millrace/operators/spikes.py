"""Implausible measurements per source: phase-space spikes, stuck values and impossible readings.

Phase-space thresholding: the readings of a source in time order span the space of value, first difference and
second difference. Good readings lie inside an ellipsoid around the median whose axes are robust (median absolute
deviation, scaled to the normal distribution) times the universal threshold sqrt(2 ln n); the value axis is held at
``reach`` median deviations at most. Readings outside any of the three projected ellipses are spikes; they are
replaced by the last good reading and the step is repeated until it finds none (or ``max_rounds`` times, if given). Zero
differences over ``min_run`` or more successive readings are stuck values; the caller's ``impossible`` condition
catches readings beyond physical bounds.

Sources are spread by hash and a task works on many of them at once with array operations. A source of more than
``max_rows`` rows is numbered in its order and cut into slices of equal length. Its size, median, deviations of value
and differences, and the sums of its tilt are taken over the whole source (distributed exact medians). Each slice also
holds the readings of a margin on either side. What lies outside can reach a few readings further with every round, so
each slice tells for how many rounds its own readings are certain; a source whose slices aren't certain for all its
rounds is done again with wider margins, in the end uncut. So flags are those of the uncut source (the tilt's sums are
added in another order). Nothing is sampled or left out at any size.

Cases: rows without id, source or value are left out; rows without time have a value axis only and belong to no run;
equal times are put in order by the id; deliveries of one (source, id) count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import broadcast_if_small, written
from millrace.operators.quantiles import exact_medians

#: From a median absolute deviation to a standard deviation of the normal distribution.
NORMAL = 1.4826
SCHEMA = (
    "ident bigint, source string, value double, n bigint, median double, deviation double, spike_round int,"
    " stuck boolean, impossible boolean, last_round bigint, certain bigint"
)
TYPES = pa.schema(
    [
        ("ident", pa.int64()), ("source", pa.string()), ("value", pa.float64()), ("n", pa.int64()), ("median", pa.float64()),
        ("deviation", pa.float64()), ("spike_round", pa.int32()), ("stuck", pa.bool_()), ("impossible", pa.bool_()),
        ("last_round", pa.int64()), ("certain", pa.int64()),
    ]
)
#: Rounds for which a slice that has all its source's readings is certain.
ALWAYS = 2**40


def _medians(values: np.ndarray, seg: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ordered = values[np.lexsort((values, seg))]
    return (ordered[starts + (sizes - 1) // 2] + ordered[starts + sizes // 2]) / 2


def _differences(u: np.ndarray, linked: np.ndarray) -> np.ndarray:
    d = np.zeros(len(u))
    d[1:] = np.where(linked[1:], u[1:] - u[:-1], 0.0)
    return d


def _beyond(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far out of the ellipse with half axes a, b (1: on it); an ellipse with an axis of length 0 judges nothing."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where((a > 0) & (b > 0), (x / a) ** 2 + (y / b) ** 2, 0.0)


def phase_space_rounds(u, seg, starts, sizes, timed, median, deviation, reach, max_rounds, given=None) -> np.ndarray:
    """The round in which each reading fell outside its source's ellipsoid, 0 for good readings.

    The axes are those of the first round, as they are robust to the spikes. Beyond the value axis a reading is a spike
    at once; by its differences only if no neighbour is further out, as the spike beside it may be what moves them: it
    is judged again once that one is replaced.

    ``given``: for slices, their sources' n, deviations of the two differences, and the tilt's two sums, per segment.
    """
    factor = np.sqrt(2 * np.log(np.maximum(sizes if given is None else given["n"], 2)))
    axis_u = (np.minimum(factor * NORMAL, reach) * deviation)[seg]
    linked = np.zeros(len(u), bool)
    linked[1:] = (seg[1:] == seg[:-1]) & timed[1:] & timed[:-1]
    z, rounds, axes = u - median[seg], np.zeros(len(u), np.int32), None
    for at in count(1) if max_rounds is None else range(1, max_rounds + 1):
        d1 = _differences(z, linked)
        d2 = _differences(d1, linked)
        if axes is None:
            if given is None:
                spread = [_medians(np.abs(d - _medians(d, seg, starts, sizes)[seg]), seg, starts, sizes) for d in (d1, d2)]
                across, along = np.add.reduceat(z * d2, starts), np.add.reduceat(z * z, starts)
            else:
                spread, across, along = [given["deviation1"], given["deviation2"]], given["across"], given["along"]
            axes = [(factor * NORMAL * x)[seg] for x in spread]
            with np.errstate(divide="ignore", invalid="ignore"):
                tilt = np.arctan(np.nan_to_num(across / along))
            c, s = np.cos(tilt)[seg], np.sin(tilt)[seg]
        b1, b2 = axes
        far = np.maximum(_beyond(z, d1, axis_u, b1), _beyond(d1, d2, b1, b2))
        far = np.maximum(far, _beyond(z * c + d2 * s, d2 * c - z * s, axis_u, b2))
        far[np.abs(z) > axis_u] = np.inf
        far[rounds > 0] = 0.0
        nearby = np.zeros(len(u))
        nearby[1:] = np.where(linked[1:], far[:-1], 0.0)
        nearby[:-1] = np.maximum(nearby[:-1], np.where(linked[1:], far[1:], 0.0))
        new = np.isinf(far) | ((far > 1) & (far >= nearby))
        if not new.any():
            break
        rounds[new] = at
        last = np.maximum.accumulate(np.where(rounds == 0, np.arange(len(u)), -1))
        usable = (last >= starts[seg]) & (rounds > 0)
        z = np.where(rounds > 0, 0.0, z)
        z[usable] = z[last[usable]]
    return rounds


def _certain(rounds, starts, ends, core_lo, core_hi, first, final) -> np.ndarray:
    """For how many rounds no reading outside a slice can have had a part in the flags of the slice's own readings.

    A flag comes from the three readings before and one after; a replaced reading from the last good one. So in each round
    doubt moves on by three readings and to the next good one from the left, by one from the right.
    """
    n = len(rounds)
    result = np.where(final, ALWAYS, ends - core_hi)
    lo, open_ = starts.copy(), ~first
    at = 0
    # Flags only grow, so what is good at the end was good in every round.
    good = np.minimum.accumulate(np.where(rounds == 0, np.arange(n), n)[::-1])[::-1]
    while open_.any():
        reached = open_ & (lo + 3 > core_lo)
        result[reached] = np.minimum(result[reached], at)
        open_ &= ~reached & (at < result)
        at += 1
        lo = np.where(open_, good[np.minimum(lo + 3, n - 1)], lo)
    return result


def _flags(t: pa.Table, reach: float, min_run: int, max_rounds: int | None) -> pa.RecordBatch:
    """One task's share of whole slices, in order of source, slice, time (null first) and id."""
    src = t["source"].combine_chunks()
    part, ident = t["slice"].to_numpy(), t["ident"].to_numpy()
    timed = pc.is_valid(t["at"]).to_numpy(zero_copy_only=False)
    at = pc.fill_null(t["at"], 0).to_numpy()
    n = len(ident)
    same = np.zeros(n, bool)
    if n > 1:
        same[1:] = pc.equal(src.slice(1), src.slice(0, n - 1)).to_numpy(zero_copy_only=False) & (part[1:] == part[:-1])
    again = same.copy()
    again[1:] &= (ident[1:] == ident[:-1]) & (at[1:] == at[:-1]) & (timed[1:] == timed[:-1])
    if again.any():
        keep = np.flatnonzero(~again)
        src, part, ident, timed, same = src.take(pa.array(keep)), part[keep], ident[keep], timed[keep], same[keep]
        t, n = t.take(pa.array(keep)), len(keep)
    u = t["value"].to_numpy().astype(float)
    impossible = pc.fill_null(t["impossible"], False).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(~same)
    sizes = np.diff(np.append(starts, n))
    seg = np.repeat(np.arange(len(starts)), sizes)
    per_slice = lambda name: t[name].to_numpy(zero_copy_only=False)[starts]
    sliced = t["n"].null_count == 0  # a task's slices are all of cut sources, or all whole sources
    if sliced:
        given = {k: per_slice(k) for k in ("n", "deviation1", "deviation2", "across", "along")}
        median, deviation, total = per_slice("median"), per_slice("deviation"), given["n"]
        own = t["own"].to_numpy(zero_copy_only=False)
    else:
        median, given, total, own = _medians(u, seg, starts, sizes), None, sizes, np.ones(n, bool)
        deviation = _medians(np.abs(u - median[seg]), seg, starts, sizes)
    rounds = phase_space_rounds(u, seg, starts, sizes, timed, median, deviation, reach, max_rounds, given)
    run_opens = np.ones(n, bool)
    run_opens[1:] = ~(same[1:] & timed[1:] & timed[:-1] & (u[1:] == u[:-1]))
    first = np.flatnonzero(run_opens)
    length = np.diff(np.append(first, n))
    run = np.repeat(np.arange(len(first)), length)
    stuck = (length[run] >= min_run) & timed & (u > 0)
    out = np.flatnonzero(((rounds > 0) | stuck | impossible) & own)
    rows = {
        "ident": ident[out], "source": src.take(pa.array(out)), "value": u[out], "n": total[seg[out]], "median": median[seg[out]],
        "deviation": deviation[seg[out]], "spike_round": rounds[out], "stuck": stuck[out], "impossible": impossible[out],
        "last_round": pa.nulls(len(out), pa.int64()), "certain": pa.nulls(len(out), pa.int64()),
    }
    flagged = pa.record_batch([pa.array(rows[f.name], f.type) if not isinstance(rows[f.name], pa.Array) else rows[f.name] for f in TYPES], schema=TYPES)
    if not sliced:
        return flagged
    at_own = np.flatnonzero(own)
    core_lo = at_own[np.searchsorted(at_own, starts)]  # the slice's own readings lie together, and there is one at least
    core_hi = core_lo + np.add.reduceat(own.astype(np.int64), starts)
    certain = _certain(rounds, starts, starts + sizes, core_lo, core_hi, per_slice("first"), per_slice("final"))
    last = np.maximum.reduceat(np.where(own, rounds, 0), starts)
    about = {"source": src.take(pa.array(starts)), "last_round": pa.array(last, pa.int64()), "certain": pa.array(certain, pa.int64())}
    slices = pa.record_batch([about.get(f.name, pa.nulls(len(starts), f.type)) for f in TYPES], schema=TYPES)
    return pa.Table.from_batches([flagged, slices]).combine_chunks().to_batches()[0]


def _scan(reach: float, min_run: int, max_rounds: int | None, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last, changed = [], 0, None, False
        for b in batches:
            if not b.num_rows:
                continue
            ends = [(b["source"][i].as_py(), b["slice"][i].as_py()) for i in (0, b.num_rows - 1)]  # rows are in order
            changed |= ends[0] != ends[1] or (last is not None and last != ends[0])
            last = ends[1]
            held.append(b)
            rows += b.num_rows
            if rows < at_once or not changed:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            src, part = t["source"].combine_chunks(), t["slice"].to_numpy()
            change = pc.not_equal(src.slice(1), src.slice(0, rows - 1)).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
            k = int(np.flatnonzero(change)[-1]) + 1
            yield _flags(t.slice(0, k), reach, min_run, max_rounds)
            held, rows, changed = t.slice(k).to_batches(), rows - k, False
        if rows:
            yield _flags(pa.Table.from_batches(held).combine_chunks(), reach, min_run, max_rounds)

    return run


STATS = ["median", "deviation", "deviation1", "deviation2", "across", "along"]
COLUMNS = ["ident", "source", "value", "at", "impossible", "slice", "n", *STATS, "own", "first", "final"]


def _numbered(d: DataFrame, large: DataFrame) -> DataFrame:
    """The readings of large sources, each once, with their place (pos, from 0) in order of time (null first) and id."""
    x = d.join(large, "source").dropDuplicates(["source", "ident", "at"])
    share = lambda v, lo, hi: F.least(F.floor((F.col(v).cast("double") - F.col(lo)) / (F.col(hi).cast("double") - F.col(lo) + 1) * F.col("parts")), F.col("parts") - 1)
    x = x.withColumn("part", F.when(F.col("at").isNull(), share("ident", "lo_id", "hi_id") - F.col("parts")).otherwise(share("at", "lo", "hi")).cast("long"))
    w = Window.partitionBy("source", "part").orderBy(F.col("at").asc_nulls_first(), "ident")
    x = written(x.select("ident", "source", "value", "at", "impossible", "part", F.row_number().over(w).cast("long").alias("row")))
    before = F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = x.groupBy("source", "part").count().select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    x = x.join(broadcast_if_small(before), ["source", "part"])
    return x.select("ident", "source", "value", "at", "impossible", (F.col("before") + F.col("row") - 1).alias("pos"))


def _whole_source_stats(readings: DataFrame, size: int) -> DataFrame:
    """source, n, STATS: what phase_space_rounds takes from a whole source, differences linked across slices."""
    centre = exact_medians(readings, ["source"], "value")
    x = readings.join(broadcast_if_small(centre), "source").withColumn("z", F.col("value") - F.col("median"))
    near = F.array_distinct(F.array(F.expr(f"pos div {size}"), F.expr(f"(pos + 2) div {size}")))
    x = x.select("source", "pos", "z", F.col("at").isNotNull().alias("timed"), F.explode(near).alias("slice"))
    w = Window.partitionBy("source", "slice").orderBy("pos")
    linked = F.col("timed") & F.coalesce(F.lag("timed").over(w), F.lit(False))
    for to, of in (("d1", "z"), ("d2", "d1")):
        x = x.withColumn(to, F.when(linked, F.coalesce(F.col(of) - F.lag(of).over(w), F.lit(0.0))).otherwise(0.0))
    x = written(x.where(f"pos div {size} = slice").select("source", "z", "d1", "d2"))
    sums = x.groupBy("source").agg(F.sum(F.col("z") * F.col("d2")).alias("across"), F.sum(F.col("z") * F.col("z")).alias("along"))
    by_kind = lambda df, **of: exact_medians(df.select("source", F.explode(F.create_map(*[c for k, v in of.items() for c in (F.lit(k), v)])).alias("kind", "v")), ["source", "kind"], "v").groupBy("source").pivot("kind", list(of)).agg(F.max("median"))
    first = by_kind(x, deviation=F.abs("z"), m1=F.col("d1"), m2=F.col("d2"))
    x = x.join(broadcast_if_small(first), "source")
    spread = by_kind(x, deviation1=F.abs(F.col("d1") - F.col("m1")), deviation2=F.abs(F.col("d2") - F.col("m2")))
    return centre.join(first.select("source", "deviation"), "source").join(spread, "source").join(sums, "source").select("source", "n", *STATS)


def _slices(readings: DataFrame, size: int, margin: int) -> DataFrame:
    """Slices of ``size`` readings with ``margin`` more on either side, in order."""
    near = F.expr(f"sequence(greatest(pos - {margin}, 0) div {size}, least(pos + {margin}, n - 1) div {size})")
    x = readings.withColumn("slice", F.explode(near)).withColumn("own", F.expr(f"pos div {size} = slice"))
    x = x.withColumn("first", F.col("slice") == 0).withColumn("final", F.expr(f"slice = (n - 1) div {size}"))
    return x.repartition("source", "slice").sortWithinPartitions("source", "slice", "pos").select(*COLUMNS)


def implausible(
    df: DataFrame,
    ident: Column,
    source: Column,
    value: Column,
    at: Column,
    impossible: Column,
    *,
    reach: float = 8.0,
    min_run: int = 6,
    max_rounds: int | None = None,
    max_rows: int = 1_000_000,
    at_once: int = 400_000,
) -> DataFrame:
    """One row for each reading that is a spike (its round), stuck or impossible: ident, source, value, n, median,
    deviation, spike_round, stuck, impossible. n, median and deviation describe the source's readings.

    A reading further from the median than ``reach`` deviations always has spike_round 1.
    """
    d = df.select(
        ident.cast("long").alias("ident"), source.alias("source"), value.cast("double").alias("value"), at.cast("long").alias("at"), impossible.alias("impossible")
    ).where("ident is not null and source is not null and value is not null")
    sizes = d.groupBy("source").agg(F.count("*").alias("rows"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("ident").alias("lo_id"), F.max("ident").alias("hi_id"))
    large = sizes.where(F.col("rows") > max_rows)
    hot = bool(large.limit(1).collect())
    scan = _scan(reach, min_run, max_rounds, at_once)
    names = ["ident", "source", "value", "n", "median", "deviation", "spike_round", "stuck", "impossible"]
    if hot:
        large = broadcast_if_small(large.withColumn("parts", F.ceil(2 * F.col("rows") / max_rows)))
    whole = d.join(large, "source", "left_anti") if hot else d
    none = {k: F.lit(None).cast(kind) for k, kind in (("n", "long"), *[(k, "double") for k in STATS], ("own", "boolean"), ("first", "boolean"), ("final", "boolean"))}
    whole = whole.select("*", F.lit(0).cast("long").alias("slice"), *[c.alias(k) for k, c in none.items()])
    whole = whole.repartition("source", "slice").sortWithinPartitions("source", "slice", F.col("at").asc_nulls_first(), "ident")
    marks = whole.select(*COLUMNS).mapInArrow(scan, SCHEMA).select(*names)
    if not hot:
        return marks
    size = max(max_rows // 2, 1)
    readings = _numbered(d, large)
    readings = readings.join(broadcast_if_small(_whole_source_stats(readings, size)), "source")
    margin = max(min_run, size // 64)
    while True:
        flags = written(_slices(readings, size, margin).mapInArrow(scan, SCHEMA))
        about = flags.where("certain is not null").groupBy("source").agg(F.min("certain").alias("certain"), F.max("last_round").alias("last"))
        doubtful = about.where(F.col("certain") < F.least(F.col("last") + 1, F.lit(max_rounds).cast("long"))).select("source")
        flags = flags.where("certain is null").select(*names)
        again = bool(doubtful.limit(1).collect())
        if not again:
            return marks.unionAll(flags)
        doubtful = broadcast_if_small(doubtful)
        marks = marks.unionAll(flags.join(doubtful, "source", "left_anti").select(*names))
        readings, margin = readings.join(doubtful, "source", "left_semi"), margin * 8
        size = max(size, margin)
