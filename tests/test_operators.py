"""The general operators on hand-made rows: edge cases, ties, missing values, empty tables."""

import math
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import distance as di
from millrace.functions import sampling
from millrace.functions.predicates import attr_filter, compile_filter
from millrace.functions.rules import compile_rule, rule_filter
from millrace.functions.season import first_cycle, parent_index, season_index
from millrace.functions.transform import Spec, transform
from millrace.functions.validators import Check, simple_validate, tag_rows, validate, validity_metric, value_dependency
from millrace.operators import extract as ex
from millrace.operators import histogram as hi
from millrace.operators import mutation as mu
from millrace.operators import profile as pr
from millrace.operators import quality as qu
from millrace.operators import relational as r
from millrace.operators import sequence as sq
from millrace.operators import similarity as si
from millrace.operators import stats as st
from millrace.operators.common import round_double
from millrace.sources import text as tx


def values(df, *names):
    return sorted((tuple(x) for x in (df.select(*names) if names else df).collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "ann", 30, 1.5), (2, "bob", None, -2.0), (3, "", 7, None), (4, None, -5, 0.0), (5, "ann", 30, 1.5)]
    return spark.createDataFrame(rows, "id int, name string, age int, score double")


# Filters and rules


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("age gt 10", {1, 5}), ("age ge int:7 and score eq double:1.5 or id eq 3", {1, 3, 5}), ("name in ann|bob", {1, 2, 5}), ("name ni ann|bob", {3, 4}), ("1 eq ann", {1, 5}), ("maxMissingFields(0)", {1, 5}),
        ("maxMissingFields(1)", {1, 2, 4, 5}), ("noMissingField(name,age)", {1, 5}), ("score lt 0", {2}), ("age ne 30", {3, 4}),
    ],
)
def test_filter(people, text, ids):
    assert {x["id"] for x in attr_filter(people, text).collect()} == ids
    rest = people.where(~compile_filter(people, text))
    assert {x["id"] for x in rest.collect()} == set(range(1, 6)) - ids


def test_filter_errors_and_options(people):
    for bad in ("age", "age like 3", "none gt 3", "nope(3)"):
        with pytest.raises((ValueError, KeyError)):
            attr_filter(people, bad)
    assert attr_filter(people, "id gt 1 && id lt 4 || id eq 5", and_sep=" && ", or_sep=" || ").count() == 3
    assert attr_filter(people, "name in set:S", sets={"S": ["bob"]}).count() == 1
    assert attr_filter(people, "odd()", functions={"odd": lambda d, a: F.col("id") % 2 == 1}).count() == 3


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("$age > 10", {1, 5}), ("$age / 4 = 7", {1, 5}), ("( $id + 1 ) * 2 >= 10 or $name = bob", {2, 4, 5}), ("if $age > 10 then $score < 1", {2, 3, 4}), ("$id * ($id - (1 + 1)) = 3", {3}), ("$age lt 8 and not_a_word eq 'not_a_word'", {3, 4}),
        ("-$age = 5", {4}), ("$score / 0 > 1", set()), ("$age / 0 = 1", set()), ("$id - 1 - 1 = 1", {3}), ("$name = 'ann'", {1, 5}),
    ],
)
def test_rules(people, text, ids):
    assert {x["id"] for x in rule_filter(people, text).collect()} == ids


def test_rules_with_stats_and_errors(spark, people):
    stats = st.numerical_stats(people, ["score"])
    assert {x["id"] for x in rule_filter(people, "$score > mean($score) + 0.5 * stdDev($score)", stats).collect()} == {1, 5}
    for bad in ("$age >", "$age > 3 )", "if $age > 3", "$age and $id", "( $age > 3"):
        with pytest.raises(ValueError):
            compile_rule(bad, people.schema)


# Seasons


def at(text):
    return int((datetime.fromisoformat(text) - datetime(1970, 1, 1)).total_seconds())


def test_seasons(spark):
    cases = [
        ("1970-01-01 00:00", "dayOfWeek", {}, 0), ("1970-01-07 23:59", "dayOfWeek", {}, 6), ("1970-01-05 00:00", "dayOfWeek", {"aligned": True}, 0), ("1970-01-04 23:59", "dayOfWeek", {"aligned": True}, 6), ("1970-01-05 10:00", "hourOfWeekDay", {}, 10),
        ("1970-01-06 10:00", "hourOfWeekDay", {}, -1), ("1970-01-06 10:00", "hourOfWeekEndDay", {}, 10), ("1969-12-31 23:00", "hourOfDay", {}, 23), ("1969-12-31 23:00", "dayOfWeek", {}, 6), ("2024-02-29 12:00", "monthOfYear", {}, 1),
        ("2024-12-31 12:00", "weekOfYear", {}, 52), ("2024-01-01 22:00", "hourOfDay", {"shift_hours": 3}, 1), ("2024-01-01 22:00", "anyDay", {"days": ["2024-01-02", "2024-01-01"]}, 1), ("2024-01-01 22:00", "noCycle", {}, 0),
    ]
    df = spark.createDataFrame([(at(t),) for t, *_ in cases], "s long")
    for i, (t, cycle, options, want) in enumerate(cases):
        got = df.where(F.col("s") == at(t)).select(season_index(F.col("s"), cycle, **options)).first()[0]
        assert got == want, (i, t, cycle)
    kind, index = first_cycle(F.col("s"), [{"cycle": "weekEndDayOfWeek"}, {"cycle": "hourRangeOfDay", "groups": [(9, 11)]}])
    got = spark.createDataFrame([(at("1970-01-06 10:00"),), (at("1970-01-02 10:00"),), (at("1970-01-02 13:00"),)], "s long").select(kind, index).collect()
    assert [tuple(x) for x in got] == [("weekEndDayOfWeek", 5), ("hourRangeOfDay", 0), ("normal", 0)]
    assert spark.range(1).select(parent_index(F.lit(-1), "hourOfDay")).first()[0] == -1
    with pytest.raises(ValueError):
        season_index(F.lit(1), "never")


# Transformers


def test_transform_engine(spark, people):
    with pytest.raises(ValueError):
        transform(people, [Spec("name", [("stringSplitTrans", {"delim": "n"}), ("trimTrans", {})], ["a", "b"])])
    with pytest.raises(ValueError):
        transform(people, [Spec("name", [("stringSplitTrans", {"delim": "n"})])])
    out = transform(people, [Spec("name", [("twice", {})])], custom_tags={"twice": lambda c, **_: F.concat(c, c)}, keep_rest=True)
    assert out.columns == ["id", "age", "score", "name"] and values(out, "id", "name")[0] == (1, "annann")
    assert transform(people.limit(0), [Spec("name", [("upperCaseTrans", {})])]).collect() == []
    failing = transform(people, [Spec("name", [("groupTrans", {"groups": {"g": ["ann"]}})], ["a", "b"])])
    with pytest.raises(Exception, match="in no group"):
        failing.collect()


def test_transform_edges(spark):
    df = spark.createDataFrame([("-2.5", "a:b:c"), ("2.5", "abc"), ("x", ""), (None, None)], "n string, s string")
    out = transform(df, [Spec("n", [("intRoundOffTrans", {})], ["r"]), Spec("n", [("discretizerTrans", {"width": 2})], ["d"]), Spec("s", [("stringSplitTrans", {"delim": ":", "at": "last"})], ["a", "b"])])
    assert values(out) == sorted([(-2, -1, "a:b", "c"), (3, 1, "abc", ""), (None, None, "", ""), (None, None, None, "")], key=lambda t: tuple((v is None, str(v)) for v in t))
    one = spark.range(1)
    shift = lambda d, u, ref: transform(one.select(F.lit(d).alias("d")), [Spec("d", [("timeCycleShiftTrans", {"unit": u, "reference": ref})])]).first()[0].isoformat()
    assert shift("2020-01-31", "month", "2020-02-15") == "2020-02-29" and shift("2020-01-31", "year", "2020-01-31") == "2020-01-31" and shift("2020-01-31", "quarter", "2020-05-01") == "2020-07-31"
    with pytest.raises(ValueError):
        transform(one.select(F.current_timestamp().alias("d")), [Spec("d", [("timeCycleTrans", {"cycles": "hourOfDay", "hour_granularity": 5})])])


# Validation


def test_validate(people):
    checks = [Check("age", "minInt", {"value": 0}), Check("age", "maxInt", {"value": 20}), Check("name", "notMissing", {})]
    v = validate(people, checks, {"scored": F.col("score").isNotNull()})
    assert v.valid.count() + v.invalid.count() == people.count() and v.valid.columns == people.columns
    tags = {x["id"]: (x["age_failed"], x["name_failed"], x["row_failed"]) for x in v.tagged.collect()}
    assert tags[1] == (["maxInt"], [], []) and tags[2] == (["minInt", "maxInt"], [], []) and tags[3] == ([], ["notMissing"], ["scored"]) and tags[4] == (["minInt"], ["notMissing"], [])
    scores = {x["id"]: x["validity"] for x in validity_metric(tag_rows(people, checks), {"age": 1, "name": 3}).collect()}
    assert scores[1] == 0.75 and scores[4] == 0
    assert validate(people.limit(0), checks).invalid.collect() == []
    assert simple_validate(people, {"age": "int"}).valid.count() == 4
    dep = people.select("id", value_dependency("name", "age", {"ann": "*", "bob": "", "": ["7"]}).alias("ok"))
    assert all(ok for _, ok in values(dep))


# Relational


def test_join_defaults(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(1, 10), (3, 30), (None, 0)], "k int, b int")
    j = lambda **o: values(r.join(a, b, ["k"], ["k"], ["a"], ["b"], **o))
    assert j() == [(1, "x", 10), (1, "y", 10)]
    assert j(right_default=-1) == [(1, "x", 10), (1, "y", 10), (2, "z", -1), (None, "n", -1)]
    assert len(j(left_default="?", right_default=-1)) == 6
    m = r.multi_join({"p": (a, "k", ["a"], None), "q": (b, "k", ["b"], None)}, outer=True)
    assert (3, "", 30) in values(m)


def test_set_dedup_split(spark, people):
    a = spark.createDataFrame([(1, "p"), (2, "q"), (2, "q"), (3, "s")], "k int, v string")
    b = spark.createDataFrame([(1, "p2"), (2, "q"), (4, "t")], "k int, v string")
    assert values(r.set_op(a, b, "intersect", ["k"])) == [(1, "p")] and values(r.set_op(a, b, "firstMinusSecond", ["k"])) == [(3, "s")] and values(r.set_op(a, b, "secondMinusFirst", ["k"])) == [(4, "t")]
    assert r.set_op(a, b, "union", ["k"]).count() == 7
    d = r.dedup(people, ["name", "score"], "duplicate", order_by=["id"])
    assert [x["id"] for x in d.result.collect()] == [1] and {x["id"] for x in d.members.collect()} == {1, 5}
    nulls = spark.createDataFrame([(None,), (None,)], "x string")
    assert r.dedup(nulls, mode="all").result.count() == 1
    s = r.split(people, "withMissingFields")
    assert {x["id"] for x in s.selected.collect()} == {2, 3, 4} and s.selected.count() + s.remaining.count() == 5
    sub = r.split(spark.range(1000), "subSample", fraction=0.3)
    assert sub.selected.count() + sub.remaining.count() == 1000 and 200 < sub.selected.count() < 400
    assert values(r.range_partition(people.where("age is not null"), "age", n=2), "id", "range_index") == [(1, 1), (3, 0), (4, 0), (5, 1)]
    assert "name" not in r.filter_missing_columns(people, 30).columns


def test_mutation(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 5)], "k int, v string, seq int")
    incr = spark.createDataFrame([(2, "B", 1), (3, "C", 2), (4, "D", 1)], "k int, v string, seq int")
    now = lambda **o: values(mu.bulk_mutate(base, incr, ["k"], "seq", **o).current, "k", "v")
    assert now() == [(1, "a"), (2, "B"), (3, "c"), (4, "D")] and now(sync="full") == [(2, "B"), (3, "c"), (4, "D")] and now(op="delete") == [(1, "a")]
    v = mu.bulk_mutate(base, incr, ["k"], "seq").versions
    assert values(v, "k", "version", "v") == [(2, 1, "B"), (2, 2, "b"), (3, 1, "c"), (3, 2, "C")]
    again = mu.bulk_mutate(mu.bulk_mutate(base, incr, ["k"], "seq", sync="full").current, incr, ["k"], "seq", sync="full").current
    assert values(again, "k", "v") == now(sync="full")
    log = spark.createDataFrame([(1, 1, "U"), (1, 2, "D"), (2, 1, "D"), (2, 2, "U")], "k int, s int, op string")
    assert values(mu.apply_event_log(log, ["k"], "s", "op"), "k", "s") == [(2, 2)]


# Statistics and histograms


def test_stats(spark, people):
    s = {x["attr"]: x for x in st.numerical_stats(people, ["age", "score"]).collect()}
    assert s["age"]["count"] == 4 and s["age"]["max"] == 30 and s["score"]["min"] == -2
    neg = spark.createDataFrame([(-3.0,), (-1.0,)], "v double")
    assert st.numerical_stats(neg, ["v"]).first()["max"] == -1.0
    assert st.numerical_stats(people.limit(0), ["age"]).collect() == [] and st.median_stats(people.limit(0), ["age"]).collect() == []
    whole = st.numerical_stats(people, ["age"], ["name"])
    part = st.running_merge(st.numerical_stats(people.where("id < 3"), ["age"], ["name"]), people.where("id >= 3"), ["name"], ["age"])
    key = lambda d: {x["name"]: (x["count"], x["sum"], x["sum_sq"]) for x in d.collect()}
    assert key(whole)["ann"] == key(part)["ann"]
    series = spark.createDataFrame([("k", i, math.sin(i / 2)) for i in range(200)], "k string, t int, v double")
    best = st.autocorrelation(series, ["k"], "t", ["v"], [3, 6, 12, 13], max_only=True).first()
    assert best["lag"] in (12, 13) and best["correlation"] > 0.9
    flat = spark.createDataFrame([("k", i, 5.0) for i in range(4)], "k string, t int, v double")
    assert st.autocorrelation(flat, ["k"], "t", ["v"], [1]).first()["correlation"] is None
    smooth = st.loess(spark.createDataFrame([("k", i, 2.0 * i + 1) for i in range(20)], "k string, t int, v double"), ["k"], "t", "v", 5)
    assert all(abs(x["smooth"] - (2 * x["t"] + 1)) < 1e-9 for x in smooth.collect())
    singular = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert all(x["mahalanobis"] is not None for x in st.mahalanobis(singular, ["x", "y"]).collect())


def test_histograms(spark):
    df = spark.createDataFrame([("a", v) for v in (-3.0, -0.5, 0.5, 1.99, 2.0, None)] + [("b", 7.0)], "k string, v double")
    h = hi.numeric_histogram(df, ["v"], {"v": 2.0}, ["k"])
    assert values(h.where("k = 'a'"), "bin", "count") == [(-1, 1), (0, 3), (1, 1)]
    assert values(hi.numeric_histogram(df, ["v"], {"v": 2.0}, ["k"], floor=True).where("k = 'a'"), "bin", "count") == [(-1, 1), (-2, 1), (0, 2), (1, 1)]
    assert h.agg(F.sum("count")).first()[0] == 6
    by = ["k", "attr"]
    one, two = hi.numeric_histogram(df.where("v < 1"), ["v"], {"v": 2.0}, ["k"]), hi.numeric_histogram(df.where("v >= 1"), ["v"], {"v": 2.0}, ["k"])
    assert values(hi.merge(one, two, by=["k", "attr", "width", "bin"])) == values(h.select(*hi.merge(one, two, by=["k", "attr", "width", "bin"]).columns))
    same = hi.kolmogorov_smirnov(h, h, by)
    assert all(x["ks"] == 0 for x in same.collect()) and all(abs(x["kl"]) < 1e-12 for x in hi.kullback_leibler(h, h, by).collect())
    normal = spark.range(20000).select(F.lit("n").alias("k"), F.round(F.randn(3) * 10, 6).alias("v"))
    fit = hi.chi_square_normal(hi.numeric_histogram(normal, ["v"], {"v": 5.0}, ["k"], floor=True).where("abs(bin) < 5"), ["k"], 0.001).first()
    uniform = spark.range(20000).select(F.lit("n").alias("k"), (F.rand(3) * 50 - 25).alias("v"))
    bad = hi.chi_square_normal(hi.numeric_histogram(uniform, ["v"], {"v": 5.0}, ["k"], floor=True), ["k"], 0.001).first()
    assert fit["chi_square"] < bad["chi_square"] / 5 and not bad["fitted"]
    assert hi.summary(h, by).where("k = 'b'").first()["q50"] == 7.0


def test_normal_cdf_and_critical(spark):
    row = spark.range(1).select(hi.normal_cdf(F.lit(1.96)), hi.normal_cdf(F.lit(-1.0)), hi.chi_square_critical(F.lit(10), 1.6448536)).first()
    assert abs(row[0] - 0.9750021) < 1e-6 and abs(row[1] - 0.1586553) < 1e-6 and abs(row[2] - 18.307) < 0.02


@pytest.mark.parametrize("outer", [False, True])
def test_multi_join_cuts_crowded_keys(spark, monkeypatch, outer):
    monkeypatch.setattr(r, "PIECE", 20_000, raising=False)
    monkeypatch.setattr(r, "LEAST", 5_000, raising=False)
    a = [(k, f"a{i // 2}") for k, n in ((1, 800), (2, 30), (3, 5), (4, 7000), (None, 3)) for i in range(n)]
    b = [(k, f"b{i}") for k, n in ((1, 150), (2, 900), (3, 4), (5, 2), (None, 2)) for i in range(n)]
    c = [(1, "c"), (2, "c"), (3, "c"), (6, "c")]
    frames = {n: (spark.createDataFrame(rows, "k int, v string"), "k", ["v"], None) for n, rows in (("a", a), ("b", b), ("c", c))}
    by = [{} for _ in range(3)]
    for side, rows in zip(by, (a, b, c), strict=True):
        for k, v in rows:
            side.setdefault(k, []).append(v)
    none, keys = ([""], set().union(*by) - {None}) if outer else ([], set(by[0]) & set(by[1]) & set(by[2]))
    want = Counter((k, x, y, z) for k in keys for x in by[0].get(k, none) for y in by[1].get(k, none) for z in by[2].get(k, none))
    if outer:
        want += Counter([(None, v, "", "") for v in by[0][None]] + [(None, "", v, "") for v in by[1][None]])
    x = r.multi_join(frames, outer)
    assert x.columns == ["key", "a_v", "b_v", "c_v"]
    assert Counter(map(tuple, x.collect())) == want
    tasks = [t["count"] for t in x.where("key = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 800 * 150 and max(tasks) < 70_000  # no task makes a crowded key's rows alone


# Profiling, quality, similarity, sequences, extraction


def test_types(spark):
    rows = [(str(i), "2024-01-%02d" % (i % 28 + 1), str(i % 2), "USD %d.50" % i, str(i * 1000), "word%d" % i, "x" if i % 2 else "y", "1.5" if i else "2") for i in range(200)]
    df = spark.createDataFrame(rows, "a string, d string, b string, m string, n string, s string, c string, f string")
    got = {x["attr"]: x["data_type"] for x in pr.infer_types(df, df.columns).collect()}
    assert got == {"a": "int", "d": "date", "b": "numericBoolean", "m": "monetaryAmount", "n": "int", "s": "string", "c": "categorical", "f": "float"}
    custom = [*pr.standard_rules(), pr.pattern_rule("word", r"word\d+", 99), pr.int_range_rule("small", 0, 199, 96)]
    got = {x["attr"]: x["data_type"] for x in pr.infer_types(df, ["a", "s"], custom).collect()}
    assert got == {"a": "small", "s": "word"}


def test_profile_counters(people):
    assert values(pr.missing_counts(people, "col", "id")) == [("age", 1), ("name", 2), ("score", 1)]
    assert values(pr.missing_counts(people, "distr", "id")) == [(0, 2), (1, 2), (2, 1)]
    assert values(pr.unique_count(people, ["name"])) == [("name", 3)]
    assert values(pr.unique_key_violations(people, ["name"])) == [("ann", 2)]
    assert values(pr.functional_dependency(people, [("name", "age")])) == [("name", "age", "", 1), ("name", "age", "ann", 1), ("name", "age", None, 1)]


def test_quality(spark, people):
    c = {x["id"]: x["completeness"] for x in qu.completeness_rows(people, {"name": 1, "age": 1}, tag="ann").collect()}
    assert c == {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.5}
    for strategy in ("minMax", "max", "zScore", "center", "decimal", "unitSum"):
        out = qu.normalize(people, ["age", "score"], strategy)
        assert out.columns == people.columns and out.count() == 5
    assert values(qu.normalize(people, ["age"], "minMax"), "id", "age")[0] == (1, 1.0)
    const = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, v double")
    assert [x["v"] for x in qu.normalize(const, ["v"], "zScore").collect()] == [None, None]
    near = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 1.0, 9.0, "b"), (2, 2.0, None, None)], "id int, d double, v double, c string")
    got = {x["id"]: x for x in qu.impute_nn(near, "id", {"v": "numeric", "c": "categorical"}, "d").collect()}
    assert abs(got[1]["imputed_v"] - 5.0) < 1e-4 and got[1]["imputed_c"] == "a" and 2 not in got


def test_similarity(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(40)], "id int, b int, v double")
    got = si.record_similarity(df, "id", [di.Part("v", "numeric", 1.0, {"scale": 10.0})], block="b", threshold=0.3)
    assert values(got, "id1", "id2") == sorted(((a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3 and b - a <= 3), key=lambda t: tuple((False, str(v)) for v in t))
    top = si.top_matches(si.both_ways(got), "id1", "id2", "distance", n=1)
    assert top.count() == 40
    row = spark.range(1).select(di.cosine(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"))), di.character_pairs(F.lit("night"), F.lit("nacht")), di.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), di.aggregate([F.lit(3.0), F.lit(4.0)])).first()
    assert abs(row[0]) < 1e-12 and row[1] == 0.75 and row[2] == 0.0 and row[3] == 2.5


def _text_records():
    words = ["red", "blue", "green", "steel", "Steel", "a", "b", "ring ring", "x-ray"]
    text = lambda i: None if i % 53 == 7 else "" if i % 31 == 3 else " ".join(words[(i * k * k + k) % 9] for k in range(1, 2 + i % 5)) + f" u{i % 40}"
    return [(i * 7 % 1009, i % 2, text(i)) for i in range(160)]


def _text_distance(how, x, y):
    if x is None or y is None:
        return None
    cut = (lambda t: [t[k : k + 2] for k in range(len(t) - 1)]) if how == "charPair" else lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    a, b = Counter(cut(x)), Counter(cut(y))
    if how == "cosine":
        n = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return 1 - sum(a[w] * b[w] for w in a) / n if n else 1.0
    m, both = len(a.keys() & b.keys()), len(a) + len(b)
    if how == "jaccard":
        both -= m
        return 1 - m / both if both else 0.0
    return 1 - 2 * m / both if both else 0.0


def _spread_texts(spark, monkeypatch, how, chunks):
    monkeypatch.setattr(si, "PAIRS", 500, raising=False)
    monkeypatch.setattr(si, "BATCH", 700, raising=False)
    rows = _text_records()
    want = {(min(a, b), max(a, b)): _text_distance(how, x, y) for k, (a, p, x) in enumerate(rows) for b, q, y in rows[k + 1 :] if p == q}
    out = si.record_similarity(spark.createDataFrame(rows, "id int, b int, v string"), "id", [di.Part("v", "text", 1.0, {"strategy": how})], block="b", chunks=chunks)
    got = out.collect()
    assert len(got) == len(want) and all(x["id1"] < x["id2"] for x in got)
    assert all(x["distance"] == want[x["id1"], x["id2"]] or abs(x["distance"] - want[x["id1"], x["id2"]]) < 1e-12 for x in got)
    tasks = [t["count"] for t in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < len(want)  # tables of few bytes, but of many pairs


@pytest.mark.parametrize("chunks", [1, 4])
def test_texts_by_cosine_are_spread(spark, monkeypatch, chunks):
    _spread_texts(spark, monkeypatch, "cosine", chunks)


@pytest.mark.parametrize("chunks", [1, 4])
def test_texts_by_jaccard_are_spread(spark, monkeypatch, chunks):
    _spread_texts(spark, monkeypatch, "jaccard", chunks)


@pytest.mark.parametrize("chunks", [1, 3])
def test_jaccard_weighs_the_record_of_the_lesser_id_first(spark, chunks):
    df = spark.createDataFrame([(i, "a " + " ".join(f"w{k}" for k in range(i))) for i in range(12)], "id int, v string")
    got = si.record_similarity(df, "id", [di.Part("v", "text", 1.0, {"strategy": "jaccard", "weight_a": 5.0, "weight_b": 2.0})], chunks=chunks, include_self=True).collect()
    assert len(got) == 78 and all(abs(x["distance"] - (1 - (x["id1"] + 1) / (x["id1"] + 1 + 2 * (x["id2"] - x["id1"])))) < 1e-12 for x in got)


@pytest.mark.parametrize("chunks", [1, 4])
def test_character_pairs_are_spread(spark, monkeypatch, chunks):
    _spread_texts(spark, monkeypatch, "charPair", chunks)


def test_mixed_parts_of_two_sets(spark):
    rows = _text_records()
    a, b = rows[:70], rows[70:]
    parts = [di.Part("n", "numeric", 3.0, {"scale": 100.0}), di.Part("v", "text", 1.0, {"strategy": "charPair"}), di.Part("v", "text", 2.0, {"strategy": "jaccard"})]
    frame = lambda x: spark.createDataFrame([(i, p, v, float(i % 17)) for i, p, v in x], "id int, b int, v string, n double")
    want = {}
    for i, p, x in a:
        for j, q, y in b:
            if p == q:
                n, c, d = abs(i % 17 - j % 17) / 100, _text_distance("charPair", x, y), _text_distance("jaccard", x, y)
                want[i, j] = n if c is None else (3 * n + c + 2 * d) / 6
    got = {(x["id1"], x["id2"]): x["distance"] for x in si.record_similarity(frame(a), "id", parts, other=frame(b), block="b", threshold=0.3, chunks=2).collect()}
    assert got.keys() == {k for k, d in want.items() if d <= 0.3} and len(got) > 20
    assert all(abs(d - want[k]) < 1e-12 for k, d in got.items())


@pytest.mark.parametrize("chunks", [1, 4])
def test_texts_by_dice_are_spread(spark, monkeypatch, chunks):
    _spread_texts(spark, monkeypatch, "dice", chunks)


@pytest.mark.parametrize("digits", [0, 4, 6, 9])
def test_distances_are_rounded_as_by_decimals(spark, digits):
    near = [k + 0.5 + e for k in (-3, -1, 0, 7, 123456) for e in (0.0, 1e-12, -1e-12, 1e-4, -1e-4, 2e-3, -2e-3)]
    xs = [k / n for n in range(1, 130) for k in range(n + 1)] + [v / 10**digits for v in near] + [-0.0, -1e-12, 0.1 + 0.2, 1e7 / 3, 1e15 / 7, -1e300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(x,) for x in xs], "d double")
    got = df.select(round_double(F.col("d"), digits).alias("a"), F.round("d", digits).alias("b")).collect()
    assert len(got) == len(xs) and all(repr(x["a"]) == repr(x["b"]) for x in got)


def test_ewma_has_a_keys_whole_history(spark):
    rows = [(k, i, None if i % 97 == 5 else float((i * 37) % 11) + (1000.0 if i < 20 else 0.0)) for k in ("a", "b", None) for i in range(700)]
    want = {}
    for k in ("a", "b", None):
        average = None
        for _, i, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            average = average if v is None else v if average is None else average + 0.01 * (v - average)
            want[k, i] = average
    got = {(x["k"], x["i"]): x["ewma"] for x in st.ewma(spark.createDataFrame(rows[::-1], "k string, i int, v double"), ["k"], "i", "v", 0.01).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sequences(spark):
    df = spark.createDataFrame([("a", 10, "x"), ("a", 10, "y"), ("a", 40, "x"), ("b", 5, "y")], "k string, t long, e string")
    assert values(sq.time_interval(df, ["k"], "t", ["e"])) == [("a", "x", 30), ("a", "y", 0)]
    assert values(sq.sequence_filter(df, ["k"], "t", "latest", tie=["e"]), "k", "t", "e") == [("a", 40, "x"), ("b", 5, "y")]
    assert values(sq.event_gap(df, ["k"], "t", "e", "y", "x", "ms"), "k", "gap") == [("a", 30)]


def test_extraction(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": 1, "d": ["x", "y"]}, {"c": 2}]}}'), (2, "bad"), (3, None), (4, '{"a": {}}')], "id int, j string")
    parsed = ex.parse_json(df, "j", "a struct<b:array<struct<c:int,d:array<string>>>>")
    flat = ex.extract_denormalized(parsed, "json", ["a.b", "a.b[].d"], {"c": "a.b[].c", "d": "a.b[].d[]."}, ["id"])
    assert values(flat) == [(1, "1", "x"), (1, "1", "y"), (1, "2", None), (2, None, None), (3, None, None), (4, None, None)]
    assert ex.extract_denormalized(parsed, "json", ["a.b", "a.b[].d"], {"c": "a.b[].c", "d": "a.b[].d[]."}, ["id"], drop_missing=True).count() == 2
    kids = ex.extract_normalized(parsed, "json", "id", {}, {"b": ("a.b", {"c": "c"})}).children["b"]
    assert values(kids) == [(1, 0, "1"), (1, 1, "2")]
    lines = spark.createDataFrame([(1, "lost"), (2, "# one"), (3, "more"), (4, "# two")], "n int, line string")
    assert values(ex.flatten_multiline(lines, "line", "n", "^#"), "line") == [("# one more",), ("# two",)]


# Sources, schemas, samplers


def test_sources(spark, tmp_path, people):
    path = str(tmp_path / "out")
    tx.write_delimited(people.select("id", "score", "name"), path, precision=1)
    back = tx.read_delimited(spark, path, people.select("id", "score", "name").schema)
    assert back.count() == 5 and {x["id"] for x in back.collect()} == {1, 2, 3, 4, 5}
    (tmp_path / "in.csv").write_text('1, a ,"x,y"\n2,,\nbad\n')
    rows = tx.read_delimited(spark, str(tmp_path / "in.csv"), ["k", "a", "b"])
    assert values(rows) == [("1", "a", "x,y"), ("2", None, None), ("bad", None, None)]
    cut = tx.split_lines(tx.read_lines(spark, str(tmp_path / "in.csv")), "value", ["k", "a", "b"])
    assert ("2", "", "") in values(cut)
    tx.write_sized(people, str(tmp_path / "sized"), mb=1, row_bytes=600_000)
    assert tx.file_map(spark.read.parquet(str(tmp_path / "sized"))).agg(F.sum("rows")).first()[0] == 5
    (tmp_path / "doc.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert tx.read_json(spark, str(tmp_path / "doc.json"), "a int", multi_line=True).count() == 2


def test_schema():
    s = schema.load('{"attributes": [{"name": "a", "ordinal": 0, "dataType": "int", "targetFieldOrdinals": [1], "odd": 1}, {"name": "b", "ordinal": 1, "dataType": "categorical", "cardinality": ["x"], "targetFieldOrdinals": [0]}]}')
    s.check_targets()
    assert s["b"].cardinality == ("x",) and s[0].name == "a" and [f.name for f in s.struct_type()] == ["a", "b"]
    with pytest.raises(ValueError):
        schema.Schema((schema.Attribute("a", 0, targets=(0, 0)),)).check_targets()


def test_sampling(spark):
    x = spark.range(4000).select(sampling.uniform(2, 3, 1).alias("u"), sampling.normal(5, 2, 2).alias("n"), sampling.categorical({"a": 1, "b": 3}, 3).alias("c"), sampling.uniform_int(1, 6, 4).alias("d"), sampling.random_text(5, 5).alias("s"), sampling.exponential(2.0, 6).alias("e"))
    s = x.agg(F.min("u"), F.max("u"), F.avg("n"), F.avg((F.col("c") == "b").cast("int")), F.min("d"), F.max("d"), F.max(F.length("s")), F.avg("e")).first()
    assert s[0] >= 2 and s[1] < 3 and abs(s[2] - 5) < 0.2 and abs(s[3] - 0.75) < 0.05 and (s[4], s[5], s[6]) == (1, 6, 5) and abs(s[7] - 0.5) < 0.05
    df = spark.range(3000).select(F.expr("if(id % 10 = 0, 'rare', 'common')").alias("k"))
    n = {r["k"]: r["count"] for r in sampling.balance_classes(df, "k").groupBy("k").count().collect()}
    assert n["rare"] == 300 and 200 < n["common"] < 400
