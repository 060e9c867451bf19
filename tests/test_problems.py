"""The operators of problems 1 and 3 to 7 against brute force and on their edge cases."""

import json
import random
from collections import defaultdict
from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from millrace.operators import column_profile as cp
from millrace.operators import nested, parse_rows, rolling
from millrace.operators.intervals import clear_runs, run_bitmaps, set_runs
from millrace.operators.quantiles import exact_medians, exact_percentiles
from millrace.operators.spikes import implausible


def gaps_and_periods(rows):
    by = defaultdict(list)
    for e, s, t in rows:
        if None not in (e, s, t) and t > s:
            by[e].append((s, t))
    gaps, periods = set(), set()
    for e, xs in by.items():
        xs.sort()
        lo, hi = xs[0]
        for s, t in xs[1:]:
            if s > hi:
                gaps.add((e, hi, s))
                periods.add((e, lo, hi))
                lo, hi = s, t
            hi = max(hi, t)
        periods.add((e, lo, hi))
    return gaps, periods


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_sweep(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["A", "A", "A", "B", None]), r.randint(-900, 900), None) for _ in range(300)]
    rows = [(e, s, None if r.random() < 0.05 else s + r.choice([-3, 0, 1, 5, 20, 260])) for e, s, _ in rows]
    rows += rows[:20] + [("C", 5, 5), ("D", 10, 20), ("D", 20, 30), ("E", -10, 60), ("E", 130, 10**6), ("E", 40, 5000), ("E", 10**6 + 3, 10**6 + 900), ("E", 200, 230)]
    df = spark.createDataFrame(rows, "entity string, s long, e long").withColumn("shard", F.lit("clash"))
    b = run_bitmaps(df, F.col("entity"), F.col("s"), F.col("e"), 50, 4)
    assert b.count() < 3000  # long intervals are not spelt out
    gaps, periods = gaps_and_periods(rows)
    assert {tuple(x) for x in clear_runs(b).collect()} == gaps
    got = [tuple(x) for x in set_runs(b, 50).collect()]
    assert set(got) == periods and len(got) == len(periods)


def test_intervals_empty(spark):
    df = spark.createDataFrame([], "entity string, s long, e long")
    b = run_bitmaps(df, F.col("entity"), F.col("s"), F.col("e"))
    assert clear_runs(b).collect() == [] and set_runs(b).collect() == []


def test_exact_medians(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", None]), r.choice([None, 0.0, -5.5, 1e12, r.gauss(0, 100), float(r.randint(-5, 5))])) for _ in range(2000)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    got = {x["k"]: (x["n"], x["median"]) for x in exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    assert got == {k: (len(v), median(v)) for k, v in by.items()}


def test_exact_percentiles_cut_crowded_bins(spark):
    """Values close together, of all magnitudes, infinities and ties, with bins cut until they are small."""
    r = random.Random(3)
    rows = [("close", 0.25 + r.randint(0, 10**6) * 1e-12) for _ in range(900)] + [("tiny", r.random() * 1e-9 * r.choice([1, -1])) for _ in range(700)] + [("same", 4.0)] * 50
    rows += [("wide", r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300)) for _ in range(501)] + [("inf", x) for x in (float("inf"), float("-inf"), 1.0, 2.0)] + [("max", x) for x in (1.7e308, -1.7e308, 1.6e308)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: x for x in exact_percentiles(df, ["k"], "v", [0.0, 0.25, 0.5, 1.0], limit=4).collect()}
    for k in {k for k, _ in rows}:
        vs = sorted(v for q, v in rows if q == k)
        assert got[k]["n"] == len(vs) and got[k]["p0"] == vs[0] and got[k]["p3"] == vs[-1] and got[k]["p2"] == pytest.approx(median(vs), rel=1e-12)
        at = 0.25 * (len(vs) - 1)
        if k not in ("inf", "max"):
            lo, hi = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            assert got[k]["p1"] == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-9, abs=1e-24)


def brute_flags(rows, k=8.0, min_run=6):
    by = defaultdict(dict)
    for i, src, v, at in rows:
        if None not in (i, src, v):
            by[src][i] = (at, v)
    out = set()
    for recs in by.values():
        vs = [v for _, v in recs.values()]
        m = median(vs)
        mad = median(abs(v - m) for v in vs)
        if len(vs) >= 20:
            out |= {i for i, (_, v) in recs.items() if abs(v - m) > k * mad}
        series = sorted((at, i, v) for i, (at, v) in recs.items() if at is not None)
        run = []
        for at, i, v in [*series, (None, None, None)]:
            if run and v != run[-1][1]:
                if len(run) >= min_run and run[0][1] > 0:
                    out |= {i for i, _ in run}
                run = []
            run.append((i, v))
    return out


@pytest.mark.parametrize("max_rows", [1_000_000, 60])
def test_spikes_against_brute_force(spark, max_rows):
    r = random.Random(4)
    rows = []
    for i in range(1500):
        src = r.choice(["hot"] * 6 + ["a", "b", "c", None])
        v = r.choice([None, 7, 7, r.randint(90, 110), 100, r.randint(0, 10**6) if r.random() < 0.1 else 101])
        rows.append((i, src, v, None if r.random() < 0.03 else r.randint(0, 700)))
    rows += [(2000 + i, "hot", 55, 100) for i in range(5)] + [(3000 + i, "run", 9, i * 40) for i in range(130)] + rows[:50]
    df = spark.createDataFrame(rows, "ident long, source string, value long, at long").withColumn("slice", F.lit(1))
    got = implausible(df, F.col("ident"), F.col("source"), F.col("value"), F.col("at"), F.col("value") < 0, max_rows=max_rows, at_once=200)
    rows_got = got.collect()
    far = {x["ident"] for x in rows_got if x["spike_round"] == 1 and x["n"] >= 20 and abs(x["value"] - x["median"]) > 8 * x["deviation"]}
    assert far | {x["ident"] for x in rows_got if x["stuck"]} == brute_flags(rows)
    assert len(rows_got) == len({x["ident"] for x in rows_got})


def test_spikes_of_cut_sources_are_those_of_whole_ones(spark):
    r = random.Random(8)
    rows = []
    for src in ("hot", "warm"):
        for i in range(900):
            v = round(100 + 8 * r.gauss(0, 1)) + (r.randint(10, 45) if r.random() < 0.15 else 0) + (10**4 if r.random() < 0.02 else 0)
            rows.append((len(rows), src, v, None if r.random() < 0.03 else 3 * i + r.randint(0, 5)))
    rows += [(5000 + i, "few", r.randint(0, 9), i) for i in range(50)]
    df = spark.createDataFrame(rows + rows[:40], "ident long, source string, value long, at long")
    args = (F.col("ident"), F.col("source"), F.col("value"), F.col("at"), F.col("value") < 0)
    whole, cut = ({tuple(x) for x in implausible(df, *args, max_rows=m, at_once=200).collect()} for m in (1_000_000, 60))
    assert len({x[6] for x in whole}) > 3 and cut == whole


@pytest.mark.parametrize("max_rows", [1_000_000, 60])
def test_spike_rounds_go_on_until_none_is_found(spark, max_rows):
    r = random.Random(5)
    v = [10_000 + r.randint(-400, 400) for _ in range(900)]
    v[300:340] = [10_000 + (-1) ** i * (800 + 18 * i) for i in range(40)]  # linked, each further out than the one before
    df = spark.createDataFrame([(i, "a", x, i) for i, x in enumerate(v)], "ident long, source string, value long, at long")
    args = (F.col("ident"), F.col("source"), F.col("value"), F.col("at"), F.col("value") < 0)
    rounds = {x["ident"]: x["spike_round"] for x in implausible(df, *args, max_rows=max_rows).collect()}
    assert max(rounds.values()) > 10
    kept = {x["ident"] for x in implausible(df, *args, max_rows=max_rows, max_rounds=max(rounds.values()) + 20).where("spike_round > 0").collect()}
    assert kept == {i for i, n in rounds.items() if n}


def test_spikes_impossible_and_empty(spark):
    df = spark.createDataFrame([(1, "a", -4, None), (2, "a", 3, None), (3, None, -1, 5)], "ident long, source string, value long, at long")
    args = (F.col("ident"), F.col("source"), F.col("value"), F.col("at"), F.col("value") < 0)
    assert {x["ident"] for x in implausible(df, *args).where("impossible").collect()} == {1}
    assert implausible(df.limit(0), *args).collect() == []


def test_rolling_state_and_versions(spark):
    r = random.Random(2)
    recs = [(r.choice("ABC"), date.fromordinal(738900 + r.randint(0, 80)), r.randint(0, 9)) for _ in range(150)] + [(None, date(2024, 1, 1), 3), ("A", None, 3), ("Z", date(2024, 1, 1), None)]
    df = spark.createDataFrame(recs, "e string, d date, x long").withColumn("amount", F.lit("clash"))
    daily = rolling.daily_amounts(df, F.col("e"), F.col("d"), F.col("x"))
    days = defaultdict(lambda: defaultdict(int))
    for e, d, x in recs:
        if None not in (e, d, x):
            days[e][d.toordinal()] += x
    want = {(e, date.fromordinal(o), *[sum(v for q, v in days[e].items() if o - n < q <= o) for n in (7, 30)]) for e in days for o in range(min(days[e]), max(days[e]) + 1)}
    got = rolling.every_day(rolling.rolling_state(daily, [7, 30]), [7, 30])
    assert {(x["entity"], x["day"], int(x["t7"]), int(x["t30"])) for x in got.collect()} == want
    first, late = daily.where("pmod(hash(day), 3) > 0"), daily.where("pmod(hash(day), 3) = 0")
    base = rolling.rolling_state(first, [7, 30])
    state = base.unionByName(rolling.advance(base, late, [7, 30], 2))
    again = rolling.every_day(rolling.current(state), [7, 30])
    assert {(x["entity"], x["day"], int(x["t7"]), int(x["t30"])) for x in again.collect()} == want
    assert rolling.every_day(rolling.rolling_state(daily.limit(0), [7]), [7]).collect() == []


def test_deliveries_count_once(spark):
    df = spark.createDataFrame([(1, "A", date(2024, 1, 1), 5), (1, "A", date(2024, 1, 1), 5), (2, "A", date(2024, 1, 1), 5)], "i long, e string, d date, x long")
    assert [int(x["amount"]) for x in rolling.daily_amounts(df, F.col("e"), F.col("d"), F.col("x"), F.col("i")).collect()] == [10]


QUOTES = {
    "": [""], "a,b": ["a", "b"], 'a,"b,c",d': ["a", "b,c", "d"], ' "x""y" ,z': ['x"y', "z"], '"a': None, '"a"b,c': None, 'a"b': None, '"",': ["", ""], ',': ["", ""], '"a" ': ["a"], '"""",x': ['"', "x"], '"a"",b': None,
    "\t\"q\"\t,r": ["q", "r"],
}


def test_quoted_cells(spark):
    more = {'a,"x\x01y,\x01c",\x01': ["a", "x\x01y,\x01c", "\x01"], '""': [""], '"a","b"': ["a", "b"], '"a" "b"': None, '"a""': None, 'a,"': None, '"a\n,b"\n': None, '"a\n,b"': ["a\n,b"], '""""""': ['""'], '"a",x"b"': None}
    long_ = '"' + '""' * 300_000 + '",' + "x," * 1000
    rows = list(enumerate([*QUOTES, *more, long_]))
    got = {i: c for i, c in parse_rows.cells_of(spark.createDataFrame(rows, "id int, line string"), "line").select("id", "_cells").collect()}
    want = [*QUOTES.values(), *more.values()]
    for i, line in rows[:-1]:
        cells = None if got[i] is None else [c.strip(" \t") for c in got[i]]
        assert cells == want[i], line
    assert len(got[rows[-1][0]]) == 1002 and len(got[rows[-1][0]][0]) == 300_000
    tabs = parse_rows.cells_of(spark.createDataFrame([('a\t "b\tc" \td',), ('"a" x\tb',)], "line string"), "line", "\t").collect()
    assert [x["_cells"] for x in tabs] == [["a", " b\tc ", "d"], None]


RULES = "ordinal_no int, attr_name string, data_type string, earliest_date string, min_value double, max_value double, exact_length int, members array<string>, string_pattern string, validators array<string>"


def test_parse_rows(spark):
    rules = spark.createDataFrame(
        [(0, "d", "date", "2024-01-01", None, None, None, None, None, None), (1, "n", "int", None, 1.0, None, None, None, None, None), (2, "x", "double", None, None, 10.0, None, None, None, None),
         (3, "c", "categorical", None, None, None, None, ["p", "q, r"], None, None), (4, "s", "string", None, None, None, 3, None, "[A-Z]+", None), (5, "k", "string", None, None, None, None, None, None, ["membershipExtSrc"])], RULES)
    known = spark.createDataFrame([("k", "K1"), ("k", "K2")], "attr_name string, value string")
    good = '2024-02-29,5,1e1,"q, r",ABC,K1'
    cases = {1: (good, None), 2: (good, None), 3: (None, "column_count"), 4: ("", "column_count"), 5: (good + ",", "column_count"), 6: ('"' + good, "quoting")}
    bad = ["2023-02-29", "2024-1-01", "2023-12-31"], ["0", "1.0", "", "2147483648", "9" * 60, "x"], ["NaN", "11", "1e400", ".5", "--1", "Infinity"], ["P", "q", ""], ["ABCD", "abc", ""], ["K3", ""]
    base, k = ["2024-02-29", " +5 ", "10.00", "p", "ABC", "K2"], 7
    for at, values in enumerate(bad):
        for v in values:
            cases[k] = (",".join(v if i == at else x for i, x in enumerate(base)), "invalid_value")
            k += 1
    cases[k] = (",".join(base).replace("+5", "0" * 50 + "5"), None)
    df = spark.createDataFrame([(i, c) for i, (c, _) in cases.items()], "id long, line string").withColumn("attr_name", F.lit("clash"))
    got = {x["id"]: x["reason"] for x in parse_rows.failures(df, "id", "line", rules, known).collect()}
    assert got == {i: r for i, (_, r) in cases.items() if r}
    sound = parse_rows.sound_rows(df, "id", "line", rules, known).collect()
    assert {x["id"] for x in sound} == {i for i, (_, r) in cases.items() if not r} and {x["n"] for x in sound} == {5} and {x["x"] for x in sound} == {10.0}
    assert parse_rows.failures(df.limit(0), "id", "line", rules, known).collect() == []


def brute_nested(text, parent, child, parent_key, child_key, key_node=None):
    """Parents and children found by plain recursion."""
    def obj(v):
        if isinstance(v, str) and v.lstrip().startswith("{"):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return v if isinstance(v, dict) else None

    def below(v, name):
        if isinstance(v, list):
            return [x for e in v for x in below(e, name)]
        o, out = obj(v), []
        for k, e in (o or {}).items():
            if k.lower() == name:
                out += [(i, obj(q)) for i, q in enumerate(e if isinstance(e, list) else [e]) if obj(q) is not None]
            else:
                out += below(e, name)
        return out

    def key(o, name):
        v = next((e for k, e in o.items() if k.lower() == name), None)
        return "" if v is None else str(v)

    try:
        root = json.loads(text)
    except (TypeError, ValueError):
        return []
    rows = []
    for pos, p in below(root, parent):
        holder = p
        if key_node:
            found = below(p, key_node)
            holder = found[0][1] if found else {}
        kids = below(p, child)
        rows += [(pos, key(holder, parent_key), i, key(c, child_key)) for i, c in kids] or [(pos, key(holder, parent_key), -1, "")]
    return rows


def test_nested_against_recursion(spark):
    from millrace.plans.problems import p4_found
    from millrace.sources import read

    d = "/root/testdata/sf0.01"
    want = []
    for kind, table, args in (("usage", "usage_docs", ("datausage", "usages", "acctid", "deviceid")), ("event", "sm_event_docs", ("entity", "eventdata", "id", "eventcode", "metadata"))):
        for r in read(spark, d, table).collect():
            want += [(kind, r["raw_id"], *x) for x in brute_nested(r["payload"], *args)]
    assert sorted(tuple(x) for x in p4_found(spark, d).collect()) == sorted(want) and len(want) > 1000


def test_nested_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "{"), (4, '{"P": NaN}'), (5, '[{"p": [null, {"K": 1.50, "c": "{\\"q\\": true}"}, 7]}]'), (6, "[" * 100_000), (7, '{"p": {"k": "\\ud800", "c": [[{"q": 1e3}, null]]}}'), (8, "[]"),
    ]
    df = spark.createDataFrame(rows, "raw_id long, payload string").withColumn("pre", F.lit(0))
    n = nested.label_nodes(df, "raw_id", "payload")
    got = sorted(tuple(x) for x in nested.parent_child(df, "raw_id", "payload", "p", "c", "k", "q").collect())
    assert got == [(5, 1, "1.50", 0, "true"), (7, 0, "�", 0, "1e3")]
    labels = [tuple(x) for x in n.where("doc_id = 5").select("pre", "post").collect()]
    assert sorted(a for a, _ in labels) == list(range(len(labels))) and sorted(b for _, b in labels) == list(range(len(labels)))
    assert nested.parent_child(df.limit(0), "raw_id", "payload", "p", "c", "k", "q").collect() == []
    assert nested.link(nested.label_nodes(df.limit(0), "raw_id", "payload"), "p", "c").collect() == []


def test_nested_parents_in_parents(spark):
    """A child belongs to the innermost parent that is still open, also after an inner parent has ended."""
    text = '{"p":[{"k":"A","p":{"k":"B","q":[{"x":"b1"}]},"q":[{"x":"a1"},{"x":"a2","p":{"k":"C"}}]},{"k":"D","q":{"x":"d1"}}]}'
    df = spark.createDataFrame([(1, text), (2, text), (2, text)], "raw_id long, payload string")
    got = [tuple(x) for x in nested.parent_child(df, "raw_id", "payload", "p", "q", "k", "x").collect()]
    one = [(0, "A", 0, "a1"), (0, "A", 1, "a2"), (0, "B", 0, "b1"), (0, "C", -1, ""), (1, "D", 0, "d1")]
    assert sorted(got) == sorted([(1, *x) for x in one] + [(2, *x) for x in one] * 2)
    nodes = nested.label_nodes(df.where("raw_id = 1"), "raw_id", "payload")
    keys = {x["pre"]: x["fields"].get("k") for x in nodes.where("node_type = 'p'").collect()}
    links = {(keys[x["parent_pre"]], x["fields"]["x"]) for x in nested.link(nodes, "p", "q").collect()}
    assert links == {("A", "a1"), ("A", "a2"), ("B", "b1"), ("D", "d1")}


SCHEMA = "schema_name string, attr_name string, data_type string, earliest_date string, min_value double, max_value double, exact_length int, members array<string>, string_pattern string, missing_tags array<string>"


def test_profile_edges(spark):
    rules = spark.createDataFrame(
        [("t", "n", "int", None, 0.0, 10.0, None, None, None, ["?"]), ("t", "c", "string", None, None, None, 2, ["ab", "cd"], "[a-z]+", ["?", "None"])], SCHEMA)
    rows = [("f", 1, 4, "ab"), ("f", 1, None, " ? "), ("f", 2, 40, "AB"), ("f", 2, 0, "none"), ("f", 2, 10, "abc"), ("f", 4, 1, "ab"), (None, 1, 1, "ab"), (None, 2, 9, "cd"), ("g", None, 1, "ab"), ("h", 1, None, None), ("h", 2, None, "")]
    df = spark.createDataFrame(rows, "feed string, seq int, n int, c string").withColumn("value", F.lit("clash"))
    j = cp.judged(cp.value_counts(cp.cells(df, "t", "feed", "seq", ["n", "c"])), rules)
    stats = {(x["feed_id"], x["load_seq"], x["column_name"]): x for x in cp.load_stats(j).collect()}
    assert stats["f", 1, "c"]["missing"] == 1 and stats["f", 2, "c"]["missing"] == 1 and stats["h", 2, "c"]["missing"] == 1
    assert stats["f", 1, "n"]["median"] == 4.0 and stats["h", 1, "n"]["median"] is None and stats["h", 1, "n"]["distinct_values"] == 0
    found = {(x["feed_id"], x["load_seq"], x["column_name"], x["finding"]) for x in cp.findings(j, 0.1, 0.25).collect()}
    assert found == {
        ("f", 2, "n", "range"), ("f", 2, "n", "missing"), ("f", 2, "n", "distinct"), ("f", 2, "n", "shift"), ("f", 2, "c", "member"), ("f", 2, "c", "length"), ("f", 2, "c", "pattern"), ("f", 2, "c", "missing"), ("f", 2, "c", "shift"),
    }
    assert cp.findings(cp.judged(cp.value_counts(cp.cells(df.limit(0), "t", "feed", "seq", ["n", "c"])), rules), 0.1, 0.25).collect() == []
