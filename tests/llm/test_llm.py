"""Digests, packing, mixing and shared spans against brute force and on their edge cases."""

import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import digest, mixing, packing, spans
from millrace.llm.tokens import count_tokens, encoder, token_sizes

# Digests


def rank_ok(values, answer, share, error):
    """Whether some rank that ``answer`` has among the values is within the bound."""
    n = len(values)
    lo, hi = np.searchsorted(values, answer, "left"), np.searchsorted(values, answer, "right")
    return lo - error * n - 1 <= share * n <= hi + error * n + 1


@pytest.mark.parametrize("error", [0.3, 0.05])
def test_compress_and_merge_keep_the_bound(error):
    r = np.random.default_rng(3)
    parts = [r.integers(-1000, 1000, 5000), (r.pareto(1.0, 8000) * 1e5).astype(np.int64), np.full(4000, 77), np.array([2**63 - 1, -(2**63), 2**62])]
    k = (digest.BITS + 1) / error
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for p in parts:
        one = digest.compress(np.zeros(len(p), np.int64), digest.codes(p), np.ones(len(p), np.int64), k)
        held = tuple(np.concatenate(x) for x in zip(held, one, strict=True))
    values = np.sort(np.concatenate(parts))
    for again in range(3):
        h, node, c = held
        assert c.sum() == len(values) and (again == 0 or len(set(zip(h.tolist(), node.tolist(), strict=True))) == len(node))
        shares = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
        for s, x in zip(shares, digest.quantiles(h, node, c, shares), strict=True):
            assert rank_ok(values, x, s, error), (again, s, x)
        held = digest.compress(h, node, c, k)
        assert all(n <= len(values) / k for n, x in zip(held[2], held[0], strict=True) if x > 0)
    assert len(held[1]) < 6 * k


def test_compress_is_the_level_by_level_rule():
    """Against a plain dictionary version of the rule."""
    def plain(nodes, k):
        n = sum(nodes.values())
        nodes = dict(nodes)
        for at in range(digest.BITS):
            for (h, low) in [x for x in nodes if x[0] == at]:
                if (h, low) not in nodes:
                    continue
                up = low & ~((1 << (at + 1)) - 1)
                family = [(at, up), (at, up | (1 << at)), (at + 1, up)]
                total = sum(nodes.get(f, 0) for f in family)
                if total <= n / k:
                    for f in family:
                        nodes.pop(f, None)
                    nodes[(at + 1, up)] = total
        return nodes

    r = random.Random(1)
    for trial in range(60):
        span = r.choice([20, 300, 2**63])
        nodes = Counter((0, r.randrange(span)) for _ in range(r.randint(1, 200)))
        k = r.choice([1.5, 4, 20, 70])
        nodes = plain(nodes, 3 * k) if trial % 2 else nodes
        for _ in range(r.randint(0, 60)):
            nodes[(0, r.randrange(span))] = nodes.get((0, r.randrange(span)), 0) + 1
        h, low, c = (np.array(x, np.int64) for x in ([n[0] for n in nodes], [(n[1] ^ (1 << 63)) - (1 << 64) * ((n[1] ^ (1 << 63)) >> 63) for n in nodes], list(nodes.values())))
        h2, low2, c2 = digest.compress(h, low, c, k)
        got = {(int(a), int(b) % (1 << 64) ^ (1 << 63)): int(n) for a, b, n in zip(h2, low2, c2, strict=True)}
        want = {x: n for x, n in plain(nodes, k).items() if n} if sum(nodes.values()) >= k else {x: n for x, n in nodes.items()}
        assert got == want, (trial, k)


def test_codes_keep_the_order_of_doubles():
    v = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 0.001, 1.0, 1e300, np.inf])
    assert (np.diff(digest.codes(v)) > 0).all() and (digest.values_of(digest.codes(v), "double") == v).all()
    assert digest.codes(np.array([-0.0]))[0] == digest.codes(np.array([0.0]))[0]


@pytest.mark.parametrize("fan_in", [64, 2])
def test_digests_of_groups(spark, monkeypatch, fan_in):
    monkeypatch.setattr(digest, "FAN_IN", fan_in)
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 8 + ["x", None]), r.choice(["2024-01-01", "2024-01-02", None]), r.choice([None, 5, r.randint(-(10**6), 10**6), int(r.paretovariate(1) * 1000)])) for _ in range(6000)] + [("empty", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "g string, d string, v long").withColumn("node", F.lit("clash")).repartition(5)
    days = digest.digests(df, {"g": F.col("g"), "day": F.to_date("d")}, F.col("v"), 0.1)
    got = digest.percentiles(digest.merge(days, {"g": F.col("g")}, 0.1), ["g"], [0.5, 0.9], 0.1).collect()
    by = defaultdict(list)
    for g, _, v in rows:
        if v is not None:
            by[g].append(v)
    assert {x["g"]: x["n"] for x in got} == {g: len(v) for g, v in by.items()} and len(got) == 2 * len(by)
    assert all(rank_ok(np.sort(by[x["g"]]), x["value"], x["share"], 0.1) for x in got)
    exact = digest.percentiles(digest.digests(df, {"g": F.col("g")}, F.col("v"), 1e-6), ["g"], [0.5], 1e-6).collect()
    assert all(x["value"] == sorted(by[x["g"]])[(len(by[x["g"]]) + 1) // 2 - 1] for x in exact)
    assert digest.percentiles(digest.digests(df.limit(0), {"g": F.col("g")}, F.col("v")), ["g"], [0.5]).collect() == []
    with pytest.raises(TypeError):
        digest.digests(df, {"g": F.col("g")}, F.col("d"))


def test_digests_of_any_number(spark):
    """Longs beyond 2^47, fractions, infinities, decimals."""
    big = spark.createDataFrame([(2**47 + i,) for i in range(1000)], "v long").repartition(3)
    at = lambda df, kind: [x["value"] for x in digest.percentiles(digest.digests(df, {"g": F.lit(1)}, F.col("v"), 0.01), ["g"], [0.1, 0.5, 0.9], 0.01, kind).orderBy("share").collect()]
    assert all(abs(x - 2**47 - 1000 * s) <= 11 for x, s in zip(at(big, "bigint"), (0.1, 0.5, 0.9), strict=True))
    small = spark.createDataFrame([(i / 1000,) for i in range(1000)], "v double").repartition(3)
    assert all(abs(x - s) <= 0.011 for x, s in zip(at(small, "double"), (0.1, 0.5, 0.9), strict=True))
    assert at(small.select(F.col("v").cast("decimal(10,3)").alias("v")), "double") == at(small, "double")
    ends = spark.createDataFrame([("a", float("nan")), ("a", float("inf")), ("a", 2.9), ("a", -1e300)], "g string, v double")
    got = digest.percentiles(digest.digests(ends, {"g": F.col("g")}, F.col("v")), ["g"], [1.0, 0.5, 0.1], kind="double").orderBy("share").collect()
    assert [x["value"] for x in got] == [-1e300, 2.9, float("inf")] and {x["n"] for x in got} == {3}


def test_hot_group_is_added_up_in_pieces(spark, monkeypatch):
    """A group's nodes are compressed as they are read, whatever their number."""
    held = digest._Held(650 / 0.5)
    monkeypatch.setattr(digest, "BUFFER", 2_000)
    r = np.random.default_rng(1)
    most = 0
    for _ in range(200):
        v = r.integers(0, 10**9, 500)
        held.add((1,), (np.zeros(500, np.int64), v, np.ones(500, np.int64)))
        most = max(most, held.size)
    assert most < 12_000 and held.settle((1,))[2].sum() == 100_000


# Packing


def test_fill_is_the_best_subset():
    r = random.Random(6)
    for _ in range(200):
        room = r.randint(0, 30)
        remaining = {n: r.randint(0, 3) for n in r.sample(range(1, 20), r.randint(1, 5))}
        best = max(s for s in (sum(n * c for n, c in zip(remaining, cs, strict=True)) for cs in itertools.product(*[range(c + 1) for c in remaining.values()])) if s <= room)
        chosen = packing.fill(room, sorted(n for n, c in remaining.items() if c), dict(remaining))
        assert sum(n * c for n, c in chosen.items()) == best and all(c <= remaining[n] for n, c in chosen.items())


@pytest.mark.parametrize(("share", "ranked"), [(512, 200_000), (8, 20)])
def test_pack(spark, monkeypatch, share, ranked):
    monkeypatch.setattr(packing, "SHARE", share)
    monkeypatch.setattr(packing, "RANKED", ranked)
    r = random.Random(7)
    sizes = {i: r.choice([0, 1, 3, 3, 3, r.randint(1, 60), r.randint(90, 350)]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").withColumn("length", F.lit("clash"))
    packs = spark.createDataFrame([("small", 40), ("big", 200)], "pack_name string, capacity int")
    got = packing.pack(df, packs).collect()
    for name, cap in (("small", 40), ("big", 200)):
        rows = [x for x in got if x["pack_name"] == name]
        per, whole = Counter(), defaultdict(list)
        for x in rows:
            per[x["container_id"]] += x["n_tokens"]
            whole[x["doc_id"]].append((x["start_token"], x["n_tokens"]))
        assert max(per.values()) <= cap and set(whole) == set(sizes)
        for i, ps in whole.items():
            ps.sort()
            assert sum(n for _, n in ps) == sizes[i] and (len(ps) == 1) == (sizes[i] <= cap)
            assert [s for s, _ in ps] == [k * cap for k in range(len(ps))]
        assert len(per) <= 1.05 * sum(sizes.values()) / cap + 1
    checked = packing.check(packing.pack(df, packs), df, packs, 0.05).collect()
    assert len(checked) == 2 and all(x["texts"] == 700 and x["placed_once"] and x["within_capacity"] and x["only_oversized_split"] and x["slack_kept"] for x in checked)
    assert packing.pack(df.limit(0), packs).collect() == []
    zero = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, n_tokens long")
    assert {(x["container_id"], x["n_tokens"]) for x in packing.pack(zero, packs).collect()} == {(0, 0)}


def test_plan_of_many_lengths():
    """Shares of a histogram with very many lengths are planned in a moment, and leave little free."""
    r = np.random.default_rng(5)
    lengths, n = np.unique(np.minimum(r.lognormal(8, 2, 400_000).astype(int) + 1, 131_072), return_counts=True)
    assert len(lengths) > 30_000
    pick = slice(5, None, 64)
    start = time.time()
    out = packing.plan(dict(zip(lengths[pick].tolist(), n[pick].tolist(), strict=True)), 131_072)
    assert time.time() - start < 60
    used = Counter()
    for times, chosen in out:
        assert sum(k * c for k, c in chosen.items()) <= 131_072
        used.update({k: c * times for k, c in chosen.items()})
    assert used == Counter(dict(zip(lengths[pick].tolist(), n[pick].tolist(), strict=True)))
    assert sum(t for t, _ in out) <= 1.01 * (lengths[pick] * n[pick]).sum() / 131_072 + 1


def test_token_sizes(spark):
    long_ = "word and more\n" * 200_000
    rows = [(1, ""), (2, "Hello <|endoftext|> world"), (3, None), (None, "x"), (4, "größe\U0001f600"), (5, long_), (2, "Hello <|endoftext|> world")]
    got = [tuple(x) for x in token_sizes(spark.createDataFrame(rows, "id long, text string").withColumn("n_tokens", F.lit(0)), "id", "text").collect()]
    e = encoder()
    assert sorted(got) == sorted((i, len(e.encode_ordinary(t))) for i, t in rows if None not in (i, t))
    assert count_tokens("a" * 10) == len(e.encode_ordinary("a" * 10))


# Mixing


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", "x", None]), f"t{i}", r.randint(0, 300)) for i in range(3000)]
    rows += [(5000 + i, "a", f"t{i}", 9) for i in range(0, 100)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, text_key string, n_tokens long").withColumn("rate", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 3), ("c", 0.2, 2), ("none", 0.05, 2)], "source_name string, target_share double, max_repeats int")
    mixed, solution = mixing.mix(sized, targets)
    got = mixed.collect()
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(0 <= x["copies"] <= caps[x["source"]] and 0 < x["rate"] <= caps[x["source"]] + 1e-9 for x in got)
    assert len({x["doc_id"] for x in got}) == len(got)
    for s, v in solution.items():  # the dual is solved, and rounding keeps the goal
        assert abs(sum(x["rate"] * x["n_tokens"] for x in got if x["source"] == s) - v["goal"]) < 1e-6 * v["goal"]
        assert abs(sum(x["copies"] * x["n_tokens"] for x in got if x["source"] == s) - v["goal"]) < 0.005 * v["goal"] + 300
    tilted = [x for x in got if x["source"] == "a"]
    v = solution["a"]
    if v["multiplier"] is not None:
        assert all(abs(x["rate"] - min(1, np.exp(v["multiplier"] * x["n_tokens"] / v["scale"]))) < 1e-9 for x in tilted)
    shares = {x["source_name"]: x["actual_share"] for x in mixing.shares(mixed, targets).collect()}
    assert shares["none"] == 0 and all(abs(shares[s] - t / 0.95) < 0.01 for s, t in (("a", 0.5), ("b", 0.25), ("c", 0.2)))
    assert all(v["converged"] and v["residual"] <= 1e-9 for v in solution.values())
    assert all(x["converged"] and x["caps_kept"] and x["share_kept"] and x["largest_total"] for x in mixing.check(mixed, targets, solution, 0.01).collect())
    half, small = mixing.mix(sized, targets, total=5000.0)
    assert abs(half.select(F.sum(F.col("copies") * F.col("n_tokens"))).collect()[0][0] - 5000) < 300
    assert mixing.mix(sized.limit(0), targets)[0].collect() == []


# Shared spans


def test_covers():
    for p, e in spans.POWERS:
        v, d = spans.perfect_cover(p, e)
        assert len(d) == p**e + 1 and {(a - b) % v for a in d for b in d} == set(range(v))
    assert spans.cover_for(200) == (91, 110, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81))


def brute_pairs(texts, n):
    windows = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else set() for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if windows[i] & windows[j]}


def brute_cover(texts, n):
    out = []
    for i, t in enumerate(texts):
        others = {u[k : k + n] for j, u in enumerate(texts) if j != i and u for k in range(len(u) - n + 1)}
        marks = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - n + 1):
            if t[k : k + n] in others:
                marks[k : k + n] = True
        out.append(int(marks.sum()))
    return out


def brute_spans(texts, n):
    """(text, other, start, length): the stretches of each different text covered by windows that the other holds."""
    out, first = set(), {}
    for i, t in enumerate(texts):
        if t is not None:
            first.setdefault(t, i)
    windows = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for t, i in first.items()}
    for t, i in first.items():
        for u, j in first.items():
            if i == j or not windows[i] & windows[j]:
                continue
            run = None
            for k in [*(k for k in range(len(t) - n + 1) if t[k : k + n] in windows[j]), None]:
                if run and (k is None or k > run[1] + n):
                    out.add((i, j, run[0], run[1] - run[0] + n))
                    run = None
                if k is not None:
                    run = (run[0] if run else k, k)
    return out


def texts_of(seed):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh é\U0001f600") for _ in range(k))
    shared = [word(k) for k in (38, 39, 40, 41, 60, 79, 200, 33)] + ["-" * 45, "ab" * 40, " " * 300]
    texts = ["", word(39), None, shared[2], "-" * 40, "-" * 39, "ab" * 300, "ba" * 21]
    for _ in range(70):
        parts = [word(r.randint(0, 150))]
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            parts += [s[r.choice([0, 0, 1]) :], word(r.randint(0, 50))]
        texts.append("".join(parts))
    return texts + [texts[10], texts[10], texts[20], texts[3]]


@pytest.mark.parametrize(("seed", "often", "crowd", "local", "block"), [(1, 64, 100, 16, 20_000), (2, 64, 100, 2, 3), (4, 1, 4, 3, 2), (6, 64, 1, 1, 4), (6, 3, 1000, 1000, 20_000)])
def test_spans_against_brute_force(spark, monkeypatch, seed, often, crowd, local, block):
    """Pairs, spans and coverage are the same whichever way the counts choose."""
    monkeypatch.setattr(spans, "LOCAL", local)
    monkeypatch.setattr(spans, "BLOCK", block)
    texts, n = texts_of(seed), 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    corpus = spans.Corpus(df, "doc_id", "text")
    got = [tuple(x) for x in spans.document_pairs(spans.linked_texts(corpus, n, often, crowd), corpus, n).collect()]
    want = brute_pairs(texts, n)
    assert set(got) == want and len(got) == len(want)
    ids = {x["text_class"]: x["doc_id"] for x in corpus.first.collect()}
    found = [(ids[x["text_class"]], ids[x["other_class"]], x["start"], x["n_chars"]) for x in spans.shared_spans(corpus, n, often, crowd).collect()]
    want = brute_spans(texts, n)
    assert set(found) == want and len(found) == len(want)
    rows = {x["doc_id"]: (x["n_chars"], x["shared_chars"]) for x in spans.coverage(spans.shared_parts(corpus, n, often, crowd), corpus, n).collect()}
    assert rows == {i: (len(t), c) for i, (t, c) in enumerate(zip(texts, brute_cover(texts, n), strict=True)) if t is not None}


def test_keys_shared_by_chance_are_replaced(spark, monkeypatch):
    real, F_ = F.xxhash64, spans.F
    monkeypatch.setattr(F_, "xxhash64", lambda *c: real(*c) if len(c) > 1 else F.pmod(real(*c), F.lit(5)) * 2)
    texts = texts_of(7)
    corpus = spans.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert corpus.odd and corpus.first.count() == len({t for t in texts if t is not None})
    assert {tuple(x) for x in spans.document_pairs(spans.linked_texts(corpus, 40), corpus, 40).collect()} == brute_pairs(texts, 40)


def test_anchors_that_meet_by_chance_prove_nothing(spark):
    """The characters decide, whatever the hashes say."""
    x, y = "abc" * 30, "abc" * 10 + "d" + "abc" * 30
    assert spans.shared_windows(x, "q" * 90, 40) == ([], []) and spans.shared_windows(x, y, 40) == ([(0, 90)], [(31, 90)])
    corpus = spans.Corpus(spark.createDataFrame([(1, x), (2, y), (3, "z" * 95)], "doc_id long, text string"), "doc_id", "text")
    ids = {r["doc_id"]: r["text_class"] for r in corpus.first.collect()}
    rows = [(ids[a], ids[b], delta, first, first, 40, False) for a, b, delta, first in ((1, 2, 31, 0), (1, 2, 30, 0), (1, 3, 0, 10), (2, 3, 3, 7))]
    chains = spark.createDataFrame(rows, "a long, b long, delta int, first int, last int, w int, far boolean")
    got = {(r["text_class"], r["other_class"]) for r in spans._extended(corpus, chains, 13, 28, 40).collect()}
    assert got == {(ids[1], ids[2]), (ids[2], ids[1])}


def test_spans_empty_and_long(spark):
    empty = spans.Corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert spans.shared_spans(empty).collect() == [] and spans.linked_texts(empty).collect() == [] and spans.shared_parts(empty).collect() == []
    r = random.Random(9)
    base = "".join(r.choice("abcdefghij") for _ in range(3_300_000))
    cut = spans.CHUNK + 50
    df = spark.createDataFrame([(1, base), (2, "x" + base[cut - 100 : cut + 100] + "y"), (3, base[cut : cut + 199])], "doc_id long, text string")
    got = spans.shared_spans(spans.Corpus(df, "doc_id", "text"))
    assert sorted((x["start"], x["n_chars"]) for x in got.collect()) == [(1, 200), (cut - 100, 200)]


def test_crowded_header_is_not_paired(spark):
    """A header below the length in all texts leads to no pairs."""
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    header, shared = word(190), word(205)
    texts = [header + word(300) + (shared if i in (3, 700) else "") for i in range(800)]
    corpus = spans.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert sorted((x["start"], x["n_chars"]) for x in spans.shared_spans(corpus).collect()) == [(490, 205), (490, 205)]


def test_one_header_in_all_texts(spark, monkeypatch):
    """5,000 texts under a header of 250 characters: coverage makes no pairs, and no bucket gets the header's anchors."""
    r = random.Random(12)
    word = lambda k: "".join(r.choices("abcdefghij", k=k))
    header = word(250)
    texts = [header + word(r.randint(300, 500)) for _ in range(5000)]
    corpus = spans.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), "doc_id", "text")
    monkeypatch.setattr(spans, "_window_pairs", None)
    got = spans.coverage(spans.shared_parts(corpus), corpus).collect()
    assert len(got) == 5000 and {x["shared_chars"] for x in got} <= set(range(250, 260))
    v, w, cover = spans.cover_for(200)
    blocks = corpus.keyed(200).mapInArrow(spans._packer(v, w, cover, 12), spans.BLOCKS).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    sizes = [x["n"] for x in blocks]
    assert len(sizes) == 12 and max(sizes) < 2 * sum(sizes) / 12
