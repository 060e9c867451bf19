"""Filling containers of fixed capacity with items, splitting none that fits.

Minimum bin slack on the multiset of remaining lengths: a container takes the longest remaining item, then the multiset
of remaining lengths that comes closest to its free room, found by subset sums on a bitset (bit s: the sum s can be
reached) with each length as often as it remains, and read back from the stored bitsets. The same filling is used again
for as many containers as the remaining counts allow: every filling takes some length's count below what it takes of it,
so a plan has at most some log2(count) fillings a length, and it is worked out from the histogram of lengths, which the
capacity bounds, however many items there are.

The histogram is dealt out to shares of about SHARE lengths of all sizes, each planned in a task of its own; fillings that
leave more than a POOR part of a container free are taken back, and their items are planned together in a last task.

Items longer than the capacity are first cut into full containers and a rest; only they are split. Items are then
assigned by their rank within their length; ranks are taken per salt, and a length has as many salts as its count asks,
so that one held by a third of all items stays spread. The plan is a table; it is joined per length and salt. Items of
length 0 need no room: they are spread over the containers (container 0 if there are none). Items without id or length
are left out; negative lengths count as 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import broadcast_if_small, written

#: Lengths a share of the histogram has, and shares at most.
SHARE, SHARES = 512, 64
#: The free part of a container from which its filling is planned again with those of other shares.
POOR = 0.002
#: Items of one length that are ranked in one task.
RANKED = 200_000


def fill(room: int, lengths: list[int], remaining: dict[int, int]) -> dict[int, int]:
    """The multiset of remaining lengths whose sum is closest to ``room`` from below: length -> count.

    ``lengths`` come in rising order and are tried from the longest that fits. Counts are taken in powers of two. It stops
    as soon as the room can be filled.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    full = 1 << room
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[at]
        left, some = min(remaining[n], room // n), 1
        while left and not reach & full:
            take = min(some, left)
            trail.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left -= take
            some *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for n, take, before in reversed(trail):
        if not before >> at & 1:
            at -= n * take
            chosen[n] = chosen.get(n, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, length -> count) of every filling, in order of the longest item."""
    remaining = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    lengths, out = sorted(remaining), []
    while lengths:
        longest = lengths[-1]
        remaining[longest] -= 1
        if not remaining[longest]:
            lengths.pop()
        chosen = fill(capacity - longest, lengths, remaining)
        if not remaining[longest]:
            lengths.append(longest)
        remaining[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(remaining[n] // c for n, c in chosen.items())
        for n, c in chosen.items():
            remaining[n] -= c * times
            if not remaining[n]:
                del lengths[bisect_left(lengths, n)]
        out.append((times, chosen))
    return out


def pieces(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity, doc_id, piece_no, start_token, length: items longer than the capacity cut, all others whole."""
    x = _per_pack(sizes.where("doc_id is not null and n_tokens is not null").withColumn("n_tokens", F.greatest(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))), packs)
    full = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("long")
    x = x.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(full, F.lit(0).cast("long")))))
    x = x.withColumn("start_token", F.col("piece_no") * F.col("capacity"))
    return x.withColumn("length", F.least(F.col("n_tokens") - F.col("start_token"), F.col("capacity").cast("long"))).drop("n_tokens")


def _per_pack(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    named = F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).alias("capacity")) for r in packs.collect()])
    return sizes.select("doc_id", "n_tokens", F.inline(named))


FILLINGS = "pack_name string, capacity int, share int, filling int, times bigint, per_container bigint, length bigint"


def _solver(poor: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        rows, back = [], {}
        for at, (times, chosen) in enumerate(plan(dict(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True)), capacity)):
            if sum(n * c for n, c in chosen.items()) < capacity * (1 - poor):
                for n, c in chosen.items():
                    back[n] = back.get(n, 0) + c * times
            else:
                rows += [(at, times, c, n) for n, c in chosen.items()]
        rows += [(-1, 1, c, n) for n, c in back.items()]  # taken back
        out = pd.DataFrame(rows, columns=["filling", "times", "per_container", "length"]).astype({"filling": "int32", "times": "int64", "per_container": "int64", "length": "int64"})
        for at, c in enumerate(("pack_name", "capacity", "share")):
            out.insert(at, c, pdf[c].iloc[0])
        return out

    return solve


def plans(histogram: DataFrame) -> DataFrame:
    """pack_name, container_from, times, rank_from, per_container, length: a row per filling and length, written.

    ``histogram``: pack_name, capacity, length, n. Its rows are bounded by the capacities, whatever the number of items.
    """
    order = Window.partitionBy("pack_name").orderBy("length")
    x = histogram.where("length > 0").withColumn("_at", F.row_number().over(order)).withColumn("_of", F.count("*").over(Window.partitionBy("pack_name")))
    shares = F.least(F.greatest(F.floor(F.col("_of") / SHARE), F.lit(1)), F.lit(SHARES))
    x = x.select("pack_name", F.col("capacity").cast("int").alias("capacity"), "length", "n", F.pmod("_at", shares).cast("int").alias("share"), (shares > 1).alias("_dealt"))
    dealt = x.where("_dealt").drop("_dealt").repartition(SHARES, "pack_name", "share").groupBy("pack_name", "capacity", "share").applyInPandas(_solver(POOR), FILLINGS)
    dealt = written(dealt)
    back = dealt.where("filling < 0").groupBy("pack_name", "capacity", "length").agg(F.sum(F.col("times") * F.col("per_container")).alias("n"))
    rest = x.where("not _dealt").select("pack_name", "capacity", "length", "n").unionByName(back).withColumn("share", F.lit(-1))
    f = dealt.where("filling >= 0").unionByName(rest.groupBy("pack_name", "capacity", "share").applyInPandas(_solver(1.0), FILLINGS))
    f = written(f)
    w = Window.partitionBy("pack_name").orderBy("share", "filling").rowsBetween(Window.unboundedPreceding, -1)
    first = f.groupBy("pack_name", "share", "filling").agg(F.first("times").alias("t")).withColumn("container_from", F.coalesce(F.sum("t").over(w), F.lit(0)))
    w = Window.partitionBy("pack_name", "length").orderBy("share", "filling").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("rank_from", F.coalesce(F.sum(F.col("times") * F.col("per_container")).over(w), F.lit(0)))
    return written(f.join(first.drop("t"), ["pack_name", "share", "filling"]).select("pack_name", "container_from", "times", "rank_from", "per_container", "length"))


def pack(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """Every item's container: pack_name, container_id, doc_id, piece_no, start_token, n_tokens.

    ``sizes``: doc_id, n_tokens (used more than once: cut its lineage first). ``packs``: pack_name, capacity, a few rows.
    """
    items = pieces(sizes, packs)
    histogram = written(items.groupBy("pack_name", "capacity", "length").agg(F.count("*").alias("n")))
    table = plans(histogram)

    # The rank of an item within its length: its rank within (length, salt) after the items of lower salts.
    hot = written(histogram.where(F.col("n") > RANKED).select("pack_name", "length", F.ceil(F.col("n") / RANKED).alias("parts")))
    salted = items.join(hot, ["pack_name", "length"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.coalesce("parts", F.lit(1))))
    key = ["pack_name", "length", "salt"]
    before = salted.groupBy(*key).agg(F.count("*").alias("n"))
    w = Window.partitionBy("pack_name", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*key, "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    # Of the fillings that take a length, each salt gets those its ranks fall into.
    upto = F.col("rank_from") + F.col("times") * F.col("per_container")
    steps = before.join(table, ["pack_name", "length"]).where((F.col("rank_from") < F.col("offset") + F.col("n")) & (upto > F.col("offset")))
    steps = steps.groupBy(*key).agg(F.first("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("rank_from", "container_from", "per_container"))).alias("steps"))
    total = table.groupBy("pack_name").agg(F.max(F.col("container_from") + F.col("times")).alias("total"))
    zeros = before.where("length = 0").join(total, "pack_name", "left").select(*key, "offset", F.coalesce("total", F.lit(1)).alias("total"))
    places = steps.select(*key, "offset", "steps", F.lit(None).cast("bigint").alias("total")).unionByName(zeros.withColumn("steps", F.lit(None).cast(dict(steps.dtypes)["steps"])))
    own = Window.partitionBy(*key).orderBy("doc_id", "piece_no")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(written(places), key)
    rank = F.col("offset") + F.col("own")
    placed = F.when(F.col("length") == 0, F.pmod(rank, F.col("total"))).otherwise(_container(F.col("steps"), rank))
    return ranked.select("pack_name", placed.cast("bigint").alias("container_id"), "doc_id", "piece_no", "start_token", F.col("length").alias("n_tokens"))


def _container(steps: Column, rank: Column) -> Column:
    """The container of a rank: that of the last filling that begins at or before it."""
    step = F.element_at(F.filter(steps, lambda s: s["rank_from"] <= rank), -1)
    return step["container_from"] + F.floor((rank - step["rank_from"]) / step["per_container"])


def summary(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity, containers, items, tokens, slack_share and the least number of containers that tokens need."""
    per = packed.groupBy("pack_name").agg(F.count_distinct("container_id").alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    x = per.join(broadcast_if_small(packs, 10_000), "pack_name")
    room = F.col("containers") * F.col("capacity")
    return x.select("pack_name", "capacity", "containers", "items", "tokens", F.round(1 - F.col("tokens") / room, 6).alias("slack_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))


def check(packed: DataFrame, sizes: DataFrame, packs: DataFrame, slack: float) -> DataFrame:
    """Per pack, whether the rules hold: pack_name, texts, placed_once, within_capacity, only_oversized_split, slack_kept.

    placed_once: the pieces of every text follow each other without hole or overlap and make up its size. slack_kept: the
    containers are at most one more than 1 / (1 - ``slack``) times the least number that the tokens need.
    """
    ends = F.col("start_token") + F.col("n_tokens")
    texts = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"), F.max(ends).alias("end"), F.count_distinct("start_token").alias("starts"))
    texts = texts.join(sizes.select("doc_id", F.col("n_tokens").alias("size")), "doc_id").join(broadcast_if_small(packs, 10_000), "pack_name")
    per_text = texts.groupBy("pack_name").agg(
        F.count("*").alias("texts"), F.every((F.col("t") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("starts") == F.col("k"))).alias("placed_once"),
        F.every((F.col("k") == 1) | (F.col("size") > F.col("capacity"))).alias("only_oversized_split"),
    )
    filled = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t")).join(broadcast_if_small(packs, 10_000), "pack_name")
    per_pack = filled.groupBy("pack_name").agg(F.every(F.col("t") <= F.col("capacity")).alias("within_capacity"), (F.count("*") <= F.sum("t") / F.first("capacity") / (1 - slack) + 1).alias("slack_kept"))
    return per_text.join(per_pack, "pack_name").select("pack_name", "texts", "placed_once", "within_capacity", "only_oversized_split", "slack_kept")
