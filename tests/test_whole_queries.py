"""Queries over whole tables against brute force over the smallest tables."""

import math
import re
from collections import Counter
from itertools import combinations

import __spark_entry__ as entry
import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def answer(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def text_distance(how, x, y):
    a, b = Counter(x), Counter(y)
    both = len(a.keys() & b.keys())
    if how == "jaccard":
        return 1 - both / len(a.keys() | b.keys())
    if how == "dice":
        return 1 - 2 * both / (len(a) + len(b))
    return 1 - sum(a[w] * b[w] for w in a) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


@pytest.mark.parametrize("how", ["jaccard", "dice", "cosine"])
def test_text_similarity_of_all_parts(spark, how):
    parts = sorted(table("part"), key=lambda p: p["p_partkey"])
    words = {p["p_partkey"]: re.findall("[a-z0-9]+", f"{p['p_name']} {p['p_type']} {p['p_brand']}".lower()) for p in parts}
    want = {(a["p_partkey"], b["p_partkey"]): text_distance(how, words[a["p_partkey"]], words[b["p_partkey"]]) for a, b in combinations(parts, 2) if a["p_brand"] == b["p_brand"]}
    got = {(x["id1"], x["id2"]): x["distance"] for x in answer(spark, f"sim_{how}")}
    assert got.keys() == want.keys() and len({p["p_size"] for p in parts}) > 10
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("name", ["sim_jaccard", "sim_dice", "sim_mixed"])
def test_similarity_rounds_few_pairs_by_decimals(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN .* THEN .*FLOOR.* ELSE round\(", plan)


@pytest.mark.parametrize("outer", [False, True])
def test_multi_join_of_whole_tables(spark, outer):
    sides = [{}, {}]
    for side, rows, key, name in ((sides[0], table("customer"), "c_nationkey", "c_name"), (sides[1], table("supplier"), "s_nationkey", "s_name")):
        for x in rows:
            side.setdefault(x[key], []).append(x[name])
    none = [""] if outer else []
    want = sorted((n["n_nationkey"], n["n_name"], c, s) for n in table("nation") for c in sides[0].get(n["n_nationkey"], none) for s in sides[1].get(n["n_nationkey"], none))
    assert sorted(map(tuple, answer(spark, f"multi_join_{'outer' if outer else 'inner'}"))) == want
    assert len({w[2] for w in want}) > 60


def test_two_sets_of_all_rows(spark):
    customers = table("customer")
    want = {(s["s_suppkey"], c["c_custkey"]): abs(s["s_acctbal"] - c["c_acctbal"]) / 5000 for s in table("supplier") for c in customers if s["s_nationkey"] == c["c_nationkey"]}
    got = {(x["id1"], x["id2"]): x["distance"] for x in answer(spark, "sim_two_sets")}
    assert got.keys() == {k for k, d in want.items() if d <= 0.5} and any(c % 10 for _, c in got)
    assert all(abs(d - want[k]) < 2e-6 for k, d in got.items())


@pytest.mark.parametrize("op", ["intersect", "union", "firstMinusSecond", "secondMinusFirst"])
def test_set_operations_leave_no_customer_out(spark, op):
    rows = [(c["c_custkey"], c["c_mktsegment"], c["c_acctbal"]) for c in table("customer")]
    a, b = [x[:2] for x in rows if x[2] < 5000], [x[:2] for x in rows if x[2] >= 0]
    want = {"intersect": set(a) & set(b), "union": a + b, "firstMinusSecond": set(a) - set(b), "secondMinusFirst": set(b) - set(a)}[op]
    assert sorted(map(tuple, answer(spark, f"set_key_{op}"))) == sorted(want) and want and {*a, *b} == {x[:2] for x in rows}


def test_sort_of_a_whole_table(spark):
    want = sorted(sorted((c["c_name"], c["c_custkey"]) for c in table("customer")), key=lambda c: c[0], reverse=True)
    assert [tuple(x) for x in answer(spark, "sort_text")] == want and len(want) > 50
