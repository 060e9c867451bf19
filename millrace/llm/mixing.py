"""Mixing sources to target shares of the total size, with capped repetition.

Entropy balancing: the rates w of the texts shall stay as close as possible, in relative entropy, to one use each, while
every source's tokens sum to its target and no rate exceeds the source's cap. The dual of this convex problem has one
multiplier per source, and its solution tilts the rates exponentially by length: w = min(cap, exp(multiplier * tokens /
mean tokens)). Newton's method solves it; every iteration is one aggregation over the distributed histogram of (source,
length), whose result is one row per source. A bracket per source keeps the steps safe. A source whose target takes all
it has at its cap has every rate at the cap.

Rates are rounded to copies: the whole part, and one more for the texts whose fraction exceeds a hash of their id by
most. The cutting point is found per source in two rounds of 4096 steps, each one aggregation whose result is a row per
source and step, so that its tokens come as close to the target as one of 16 million steps allows. Rounding never
passes the cap.

One text counts once wherever it occurs: its record with the smallest id among the sources of the mix stands for it, so
no text is used more often than its cap allows. Records without source, id or text, and those of sources without
a target, are not drawn; neither are texts of 0 tokens. Unless a total is given it is the largest that every source with
texts can reach; a source without any texts has share 0, and the others keep their proportions.

The solution tells per source the rounds taken, the residual (how far the tokens of the rates are from the goal, as a part
of it) and whether it converged; a source that did not within the rounds is told so, not passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import broadcast_if_small, cut

STEPS = 4096
LIMIT = 200.0


def distinct_texts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, one row per text of the mix. ``sized``: doc_id, source, text_key, n_tokens."""
    named = broadcast_if_small(targets.select(F.col("source_name").alias("source")), 10_000)
    x = sized.where("n_tokens > 0").join(named, "source", "left_semi")
    return x.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r")).select("r.*")


def _lookup(values: dict[str, float], source: Column) -> Column:
    """A per-source number, as a literal map: sources are the rows of the target table."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.create_map(*pairs)[source] if pairs else F.lit(None).cast("double")


def solve(lengths: DataFrame, targets: list[dict], total: float | None = None, tolerance: float = 1e-9, rounds: int = 60) -> dict[str, dict]:
    """Per source: multiplier (None where every rate is at the cap), scale, goal, available, cap, rounds, residual, converged.

    ``lengths``: source, n_tokens, n.
    """
    sums = {r["source"]: r for r in lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("texts")).collect()}
    have = [t for t in targets if t["source_name"] in sums and t["target_share"] > 0 and t["max_repeats"] > 0]
    weight = sum(t["target_share"] for t in have)
    out: dict[str, dict] = {}
    if not have:
        return out
    reach = {t["source_name"]: float(sums[t["source_name"]]["tokens"]) * t["max_repeats"] for t in have}
    most = min(reach[t["source_name"]] * weight / t["target_share"] for t in have)
    whole = most if total is None else float(total)
    for t in have:
        s = t["source_name"]
        goal = whole * t["target_share"] / weight
        full = goal >= reach[s] * (1 - 1e-12)
        out[s] = {"multiplier": None if full else 0.0, "scale": sums[s]["tokens"] / sums[s]["texts"], "goal": min(goal, reach[s]), "available": sums[s]["tokens"], "cap": t["max_repeats"], "lo": -LIMIT, "hi": LIMIT, "rounds": 0, "residual": 0.0, "converged": full}
    open_ = {s for s, v in out.items() if v["multiplier"] is not None}
    for _ in range(rounds):
        if not open_:
            break
        z = F.col("n_tokens") / _lookup({s: out[s]["scale"] for s in open_}, F.col("source"))
        tilt = F.exp(F.least(_lookup({s: out[s]["multiplier"] for s in open_}, F.col("source")) * z, F.lit(50.0)))
        cap = _lookup({s: out[s]["cap"] for s in open_}, F.col("source"))
        used = F.col("n") * F.col("n_tokens") * F.least(tilt, cap)
        slope = F.when(tilt < cap, F.col("n") * F.col("n_tokens") * z * tilt).otherwise(0.0)
        at = lengths.where(F.col("source").isin(list(open_))).groupBy("source").agg(F.sum(used).alias("f"), F.sum(slope).alias("g")).collect()
        for r in at:
            v = out[r["source"]]
            miss = r["f"] - v["goal"]
            v["rounds"], v["residual"] = v["rounds"] + 1, abs(miss) / v["goal"]
            v["converged"] = abs(miss) <= tolerance * v["goal"]
            if abs(miss) <= tolerance * v["goal"] or v["hi"] - v["lo"] < 1e-12:
                open_.discard(r["source"])
                continue
            v["hi" if miss > 0 else "lo"] = v["multiplier"]
            step = v["multiplier"] - miss / r["g"] if r["g"] > 0 else math.inf
            v["multiplier"] = step if v["lo"] < step < v["hi"] else (v["lo"] + v["hi"]) / 2
    return out


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> tuple[DataFrame, dict[str, dict]]:
    """(doc_id, source, n_tokens, rate, copies of every text of the mix, the solution per source)."""
    wanted = [r.asDict() for r in targets.select("source_name", "target_share", "max_repeats").collect()]
    texts = cut(distinct_texts(sized, targets))
    lengths = cut(texts.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    solution = solve(lengths, wanted, total)
    if not solution:
        return texts.where("false").select("*", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")), solution
    x = texts.where(F.col("source").isin(list(solution)))
    full = [s for s, v in solution.items() if v["multiplier"] is None]
    cap = _lookup({s: v["cap"] for s, v in solution.items()}, F.col("source"))
    z = F.col("n_tokens") / _lookup({s: v["scale"] for s, v in solution.items()}, F.col("source"))
    tilt = F.exp(F.least(_lookup({s: v["multiplier"] or 0.0 for s, v in solution.items()}, F.col("source")) * z, F.lit(50.0)))
    x = x.withColumn("rate", F.when(F.col("source").isin(full), cap).otherwise(F.least(tilt, cap)))
    x = x.withColumn("whole", F.floor("rate").cast("int")).withColumn("cap", cap.cast("int"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40)) / F.lit(2.0**40)
    fraction = F.when(F.col("whole") < F.col("cap"), (F.col("rate") - F.col("whole") - chance + 1) * (STEPS / 2))
    x = x.withColumn("step", F.floor(fraction).cast("int")).withColumn("part", F.floor((fraction - F.floor(fraction)) * STEPS).cast("int"))
    x = x.select("doc_id", "source", "n_tokens", "rate", "whole", "step", "part")
    now = {r[0]: float(r[1]) for r in x.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens"))).collect()}
    goals = {s: v["goal"] for s, v in solution.items()}
    # Per source the tokens of every step, STEPS at most, then of the parts of the one step in which the goal is passed.
    step_at = _cutting_points(x, "step", now, goals, nearest=False)
    at = x.where(F.col("step") == _lookup(step_at, F.col("source")))
    part_at = _cutting_points(at, "part", now, goals, nearest=True)
    first, second = _lookup(step_at, F.col("source")), _lookup(part_at, F.col("source"))
    extra = F.when((F.col("step") > first) | ((F.col("step") == first) & (F.col("part") > second)), 1).otherwise(0)
    return x.select("doc_id", "source", "n_tokens", "rate", (F.col("whole") + extra).cast("int").alias("copies")), solution


def _cutting_points(x: DataFrame, by: str, now: dict[str, float], goals: dict[str, float], nearest: bool) -> dict[str, float]:
    """Per source the step, from above, in which its tokens pass the goal (-1 if in none); those above it are drawn.

    ``now``, the tokens drawn, is brought up to date. ``nearest``: the passing step is drawn as well if that is nearer.
    """
    tokens: dict[str, list] = {}
    for r in x.where(F.col(by).isNotNull()).groupBy("source", by).agg(F.sum("n_tokens").alias("t")).collect():
        tokens.setdefault(r["source"], []).append((r[by], float(r["t"])))
    out = {}
    for s, goal in goals.items():
        out[s] = -1.0
        for step, t in sorted(tokens.get(s, []), reverse=True):
            passed = now[s] + t - goal
            if passed > 0:
                nearer = nearest and passed < goal - now[s]
                now[s] += t if nearer else 0.0
                out[s] = step - 1.0 if nearer else float(step)
                break
            now[s] += t
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and actual share, tokens and texts available and drawn, the largest number of copies."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("available_tokens"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"),
        F.sum((F.col("copies") > 0).cast("int")).alias("drawn_texts"),
        F.max("copies").alias("most_copies"),
    )
    x = targets.select(F.col("source_name").alias("source"), "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["available_tokens", "drawn_tokens", "drawn_texts", "most_copies"])
    x = x.withColumn("actual_share", F.round(F.col("drawn_tokens") / F.sum("drawn_tokens").over(Window.partitionBy()), 6))  # a row per target
    return x.select(F.col("source").alias("source_name"), "target_share", "actual_share", "available_tokens", "drawn_tokens", "drawn_texts", "most_copies", "max_repeats")


def check(mixed: DataFrame, targets: DataFrame, solution: dict[str, dict], tolerance: float) -> DataFrame:
    """Per target source: texts, converged, caps_kept, share_kept, largest_total.

    share_kept: the drawn share differs from the target, in proportion among the sources that have texts, by at most
    ``tolerance``. largest_total: some source with texts is used up, all its texts at the cap.
    """
    state = [(s, v["converged"], v["multiplier"] is None) for s, v in solution.items()]
    state = mixed.sparkSession.createDataFrame(state, "source string, converged boolean, full boolean")  # a row per target
    got = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most"), F.min("copies").alias("least"))
    x = broadcast_if_small(targets.select(F.col("source_name").alias("source"), "target_share", "max_repeats"), 10_000).join(got, "source", "left").join(state, "source", "left")
    every = Window.partitionBy()  # a row per target
    share = F.col("drawn") / F.sum("drawn").over(every)
    want = F.when(F.col("texts") > 0, F.col("target_share")) / F.sum(F.when(F.col("texts") > 0, F.col("target_share"))).over(every)
    used_up = F.max(F.coalesce(F.col("full") & (F.col("least") == F.col("max_repeats")), F.lit(False))).over(every)
    yes = F.lit(True)
    return x.select(
        F.col("source").alias("source_name"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("converged", yes).alias("converged"), F.coalesce(F.col("most") <= F.col("max_repeats"), yes).alias("caps_kept"),
        F.coalesce(F.abs(share - want) <= tolerance, yes).alias("share_kept"), used_up.alias("largest_total"),
    )
