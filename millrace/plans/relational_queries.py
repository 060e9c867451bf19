"""Queries of projection, filters, rules, joins, set operations, de-duplication, mutation and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.predicates import attr_filter
from millrace.functions.rules import rule_filter
from millrace.functions.season import season_index
from millrace.operators import mutation as mu
from millrace.operators import relational as r
from millrace.operators import sequence as sq
from millrace.operators import stats as st
from millrace.operators.common import epoch_ms
from millrace.plans.registry import Registry

registry = Registry()
add = registry.add

# Projection, grouping, ordering

add("project_simple", lambda t: r.project(t.orders, ["o_orderkey", "o_totalprice"], where="o_orderstatus eq F", key="o_orderkey"), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
add("project_exclude_cols", lambda t: r.project(t.part, exclude=["p_name", "p_size"]), "select p_partkey, p_brand, p_type, p_retailprice from part")
add(
    "project_group_aggs",
    lambda t: r.group_aggregate(t.orders, ["o_orderpriority"], "o_totalprice", ["count", "uniqueCount", "sum", "average", "max", "min", "stdDev"]).select(
        "o_orderpriority", "count_o_totalprice", "uniqueCount_o_totalprice", *[F.round(f"{f}_o_totalprice", 2).alias(f"{f}_o_totalprice") for f in ("sum", "average", "max", "min", "stdDev")]
    ),
    """select o_orderpriority, count(o_totalprice) count_o_totalprice, count(distinct o_totalprice) uniqueCount_o_totalprice, round(sum(o_totalprice), 2) sum_o_totalprice, round(avg(o_totalprice), 2) average_o_totalprice,
    round(max(o_totalprice), 2) max_o_totalprice, round(min(o_totalprice), 2) min_o_totalprice, round(stddev_pop(o_totalprice), 2) stdDev_o_totalprice from orders group by 1""",
)
add(
    "project_group_maxima",
    lambda t: r.group_maxima(r.group_aggregate(t.orders, ["o_custkey"], "o_totalprice", ["count", "max"]), ["o_custkey"]),
    "select max(c) max_count_o_totalprice, max(m) max_max_o_totalprice from (select count(o_totalprice) c, max(o_totalprice) m from orders group by o_custkey)",
)
_TOP = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders"
_by_price = lambda: [F.col("o_totalprice").desc(), "o_orderkey"]
add("group_topn_long", lambda t: r.order_within(t.orders, ["o_custkey"], _by_price(), ["o_orderkey"], limit=3), f"select o_custkey, o_orderkey from ({_TOP}) where rn <= 3")
add("group_rank", lambda t: r.order_within(t.orders, ["o_custkey"], _by_price(), ["o_orderkey"], rank=True), f"select o_custkey, cast(rn as int) as rank from ({_TOP})")
add("group_compact", lambda t: r.order_within(t.orders, ["o_custkey"], _by_price(), ["o_orderkey"], limit=3, compact=True), f"select o_custkey, list(o_orderkey order by rn) as ordered from ({_TOP}) where rn <= 3 group by 1")
add("sort_text", lambda t: r.sort_by(t.customer.select("c_name", "c_custkey"), "c_name", descending=True, then=["c_custkey"]), "select c_name, c_custkey from customer order by c_name desc, c_custkey")
add("sort_numeric_topk", lambda t: r.sort_by(t.customer.select("c_acctbal", "c_custkey"), "c_acctbal", descending=True, numeric=True, limit=50, then=["c_custkey"]), "select c_acctbal, c_custkey from customer order by c_acctbal desc, c_custkey limit 50")
add(
    "secondary_sort_check",
    lambda t: r.is_sorted_within(r.secondary_sort(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]), ["o_custkey"], "o_orderkey").agg(F.sum("rows").alias("rows"), F.sum("steps_down").alias("steps_down")),
    "select count(*) as rows, cast(0 as bigint) steps_down from orders",
)

# Filters

add("filter_dnf_int", lambda t: attr_filter(t.lineitem, "l_linenumber gt 5 and l_suppkey le 50 or l_linenumber eq int:1 and l_suppkey ge int:90").select("l_orderkey", "l_linenumber", "l_suppkey"),
    "select l_orderkey, l_linenumber, l_suppkey from lineitem where (l_linenumber > 5 and l_suppkey <= 50) or (l_linenumber = 1 and l_suppkey >= 90)")
add("filter_dnf_double", lambda t: attr_filter(t.lineitem, "5 ge double:90000.5 or l_discount lt 0.01").select("l_orderkey", "l_extendedprice", "l_discount"),
    "select l_orderkey, l_extendedprice, l_discount from lineitem where l_extendedprice >= 90000.5 or l_discount < 0.01")
add("filter_dnf_string", lambda t: attr_filter(t.customer, "c_mktsegment gt FURNITURE and c_name lt string:Customer#000000100").select("c_custkey", "c_mktsegment"),
    "select c_custkey, c_mktsegment from customer where c_mktsegment > 'FURNITURE' and c_name < 'Customer#000000100'")
add("filter_in", lambda t: attr_filter(t.customer, "c_mktsegment in MACHINERY|BUILDING").select("c_custkey"), "select c_custkey from customer where c_mktsegment in ('MACHINERY', 'BUILDING')")
add("filter_not_in", lambda t: attr_filter(t.customer, "c_mktsegment ni set:OFF", sets={"OFF": ["MACHINERY", "BUILDING"]}).select("c_custkey"), "select c_custkey from customer where c_mktsegment not in ('MACHINERY', 'BUILDING')")
add("filter_named_set_semi", lambda t: r.named_set_filter(t.customer, "c_custkey", t.orders, "o_custkey").select("c_custkey"), "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
add("filter_named_set_anti", lambda t: r.named_set_filter(t.customer, "c_custkey", t.orders, "o_custkey", keep=False).select("c_custkey"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
add("filter_row_column", lambda t: r.row_column_filter(t.supplier, "s_nationkey", t.nation.where("n_regionkey = 1"), "n_nationkey", ["s_acctbal"]), "select s_suppkey, s_name, s_nationkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")


def _holes(t):
    return t.events.select("event_id", F.expr("case when event_id % 3 <> 0 then event_type end").alias("event_type"), F.expr("case when event_id % 5 <> 0 then value end").alias("value"), F.expr("case when event_id % 7 <> 0 then props else '' end").alias("props"))


_HOLES = "h as (select event_id, case when event_id % 3 <> 0 then event_type end event_type, case when event_id % 5 <> 0 then value end as value, case when event_id % 7 <> 0 then props else '' end props from events)"
_MISSES = "((event_type is null or event_type = '')::int + (value is null)::int + (props is null or props = '')::int)"
add("filter_max_missing", lambda t: attr_filter(_holes(t), "maxMissingFields(1)").select("event_id"), f"with {_HOLES} select event_id from h where {_MISSES} <= 1")
add("filter_no_missing", lambda t: attr_filter(_holes(t), "noMissingField(event_type,3)").select("event_id"), f"with {_HOLES} select event_id from h where trim(event_type) <> '' and trim(props) <> ''")
add("filter_missing_rows", lambda t: r.filter_missing_rows(_holes(t), 0).select("event_id"), f"with {_HOLES} select event_id from h where {_MISSES} = 0")
add("filter_missing_cols", lambda t: r.filter_missing_columns(_holes(t), 16), f"with {_HOLES} select event_id, props from h")
add("filter_rule_arith", lambda t: rule_filter(t.lineitem, "( $l_extendedprice * ( 1 - $l_discount ) ) / $l_quantity > 4000 and $l_linenumber / 2 = 1", project=["l_orderkey", "l_linenumber"]),
    "select l_orderkey, l_linenumber from lineitem where l_extendedprice * (1 - l_discount) / l_quantity > 4000 and l_linenumber // 2 = 1")
add("filter_rule_implication", lambda t: rule_filter(t.lineitem, "if $l_returnflag = R or $l_quantity > 40 then $l_discount >= 0.05", project=["l_orderkey", "l_linenumber"]),
    "select l_orderkey, l_linenumber from lineitem where not (l_returnflag = 'R' or l_quantity > 40) or l_discount >= 0.05")
add("filter_rule_mean_sd", lambda t: rule_filter(t.events, "$value > mean($value) + 2 * stdDev($value)", st.numerical_stats(t.events, ["value"], ["event_type"]), ["event_type"], ["event_id"]),
    "select event_id from events join (select event_type, avg(value) m, stddev_pop(value) s from events group by 1) using (event_type) where value > m + 2 * s")
add("filter_zscore", lambda t: r.zscore_filter(t.events, ["value"], 1.5, ["event_type"]).select("event_id"),
    "select event_id from events join (select event_type, avg(value) m, stddev_pop(value) s from events group by 1) using (event_type) where abs(value - m) <= 1.5 * s")


def _stats(t):
    s = st.numerical_stats(t.events, ["value"], ["user_id"]).withColumn("range", F.col("max") - F.col("min"))
    n = t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("cardinality"))
    return s.join(n, "user_id")


for _name, _limit, _sql in (
    ("count", 8, "count(value)"), ("mean", 50.0, "avg(value)"), ("stdDev", 45.0, "stddev_pop(value)"), ("range", 150.0, "max(value) - min(value)"), ("cardinality", 4, "count(distinct event_type)"),
):
    for _side, _op in (("Above", ">="), ("Below", "<")):
        add(
            f"filter_stats_based_{_name}_{_side.lower()}",
            lambda t, n=_name, s=_side, v=_limit: r.filter_by_stats(t.events, _stats(t), ["user_id"], {"value": {f"{n}{s}": v}}).select("event_id"),
            f"select event_id from events where user_id in (select user_id from events group by 1 having {_sql} {_op} {_limit})",
        )

_S = "(epoch_us(ts) // 1000000)"
_WD = f"(({_S} % 604800) // 86400)"
_H = f"(({_S} % 86400) // 3600)"
CYCLES = {
    "noCycle": ({}, "0"), "dayOfWeek": ({}, _WD), "hourOfDay": ({}, _H), "quarterHourOfDay": ({}, f"(({_S} % 86400) // 900)"), "halfHourOfDay": ({}, f"(({_S} % 86400) // 1800)"), "sixHourOfDay": ({}, f"(({_S} % 86400) // 21600)"),
    "twelveHourOfDay": ({}, f"(({_S} % 86400) // 43200)"), "hourOfWeekDay": ({}, f"case when {_WD} < 5 then {_H} else -1 end"), "hourOfWeekEndDay": ({}, f"case when {_WD} > 4 then {_H} else -1 end"),
    "quarterHourOfWeekDay": ({}, f"case when {_WD} < 5 then (({_S} % 86400) // 900) else -1 end"), "quarterHourOfWeekEndDay": ({}, f"case when {_WD} > 4 then (({_S} % 86400) // 900) else -1 end"),
    "halfHourOfWeekDay": ({}, f"case when {_WD} < 5 then (({_S} % 86400) // 1800) else -1 end"), "halfHourOfWeekEndDay": ({}, f"case when {_WD} > 4 then (({_S} % 86400) // 1800) else -1 end"),
    "sixHourOfWeekDay": ({}, f"case when {_WD} < 5 then (({_S} % 86400) // 21600) else -1 end"), "sixHourOfWeekEndDay": ({}, f"case when {_WD} > 4 then (({_S} % 86400) // 21600) else -1 end"),
    "twelveHourOfWeekDay": ({}, f"case when {_WD} < 5 then (({_S} % 86400) // 43200) else -1 end"), "twelveHourOfWeekEndDay": ({}, f"case when {_WD} > 4 then (({_S} % 86400) // 43200) else -1 end"),
    "weekDayOfWeek": ({}, f"case when {_WD} < 5 then {_WD} else -1 end"), "weekEndDayOfWeek": ({}, f"case when {_WD} > 4 then {_WD} else -1 end"), "weekDayOrWeekendOfWeek": ({}, f"case when {_WD} < 5 then 0 else 1 end"),
    "dayHolidayOfWeek": ({"days": ["2024-01-01", "2024-01-15"]}, f"case when cast(ts as date) in ('2024-01-01', '2024-01-15') then 7 else {_WD} end"),
    "weekDayHolidayOfWeek": ({"days": ["2024-01-01"]}, f"case when cast(ts as date) = '2024-01-01' then 5 when {_WD} < 5 then {_WD} else -1 end"),
    "weekDayHolidayOrWeekendOfWeek": ({"days": ["2024-01-01"]}, f"case when cast(ts as date) = '2024-01-01' or {_WD} > 4 then 1 else 0 end"),
    "hourRangeOfDay": ({"groups": [(6, 11), (12, 17)]}, f"case when {_H} between 6 and 11 then 0 when {_H} between 12 and 17 then 1 else -1 end"),
    "hourRangeOfWeekDay": ({"groups": [(6, 11)]}, f"case when {_WD} < 5 and {_H} between 6 and 11 then 0 else -1 end"), "hourRangeOfWeekEndDay": ({"groups": [(6, 11)]}, f"case when {_WD} > 4 and {_H} between 6 and 11 then 0 else -1 end"),
    "dayRangeOfWeek": ({"groups": [(0, 2), (3, 3)]}, f"case when {_WD} <= 2 then 0 when {_WD} = 3 then 1 else -1 end"), "monthRangeOfYear": ({"groups": [(0, 1), (2, 5)]}, "case when month(ts) <= 2 then 0 when month(ts) <= 6 then 1 else -1 end"),
    "nightDayHourOfDay": ({"groups": [(7, 19)]}, f"case when {_H} >= 7 and {_H} < 19 then 1 else 0 end"), "monthOfYear": ({}, "month(ts) - 1"), "weekOfYear": ({}, "(dayofyear(ts) - 1) // 7"),
    "anyDay": ({"days": ["2024-01-03", "2024-01-05"]}, "case when cast(ts as date) = '2024-01-03' then 0 when cast(ts as date) = '2024-01-05' then 1 else -1 end"),
    "anyTimeRange": ({"spans": [(1704153600, 1704240000), (1704230000, 1704500000)]}, f"case when {_S} between 1704153600 and 1704240000 then 0 when {_S} between 1704230000 and 1704500000 then 1 else -1 end"),
}


def _seconds(df):
    return F.floor(epoch_ms(df, "ts") / 1000).cast("long")


for _cycle, (_options, _sql) in CYCLES.items():
    add(
        f"filter_temporal_{_cycle}",
        lambda t, c=_cycle, o=_options: t.events.select("event_id", season_index(_seconds(t.events), c, **o).alias("cycle_index")).where("cycle_index >= 0"),
        f"select event_id, cast({_sql} as bigint) cycle_index from events where {_sql} >= 0",
    )
add("season_aligned_week", lambda t: t.events.select("event_id", season_index(_seconds(t.events), "dayOfWeek", shift_hours=-5, aligned=True).alias("day")), "select event_id, cast(isodow(ts - interval 5 hour) - 1 as bigint) as day from events")

_SEQ = "select *, row_number() over (partition by user_id order by ts, event_id) a, row_number() over (partition by user_id order by ts desc, event_id desc) z from events"
add("seq_earliest", lambda t: sq.sequence_filter(t.events, ["user_id"], "ts", "earliest", tie=["event_id"]).select("user_id", "event_id"), f"select user_id, event_id from ({_SEQ}) where a = 1")
add("seq_latest", lambda t: sq.sequence_filter(t.events, ["user_id"], "ts", "latest", tie=["event_id"]).select("user_id", "event_id"), f"select user_id, event_id from ({_SEQ}) where z = 1")
add("seq_range", lambda t: sq.sequence_filter(t.events, ["user_id"], "ts", "range", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")).select("user_id", "event_id"),
    "select user_id, event_id from events where ts > '2024-01-05' and ts < '2024-01-12'")
add("seq_compact", lambda t: sq.sequence_filter(t.events, ["user_id"], "ts", "none", tie=["event_id"], compact="event_id"), "select user_id, list(event_id order by ts, event_id) as sequence from events group by 1")
add("seq_number", lambda t: sq.number(t.events, ["user_id"], "ts", ["event_id"]).select("event_id", "seq"), f"select event_id, cast(a as int) seq from ({_SEQ})")
add("time_interval", lambda t: sq.time_interval(t.events.select("user_id", "event_id", epoch_ms(t.events, "ts").alias("ms")), ["user_id"], "ms", ["event_id"]),
    "select * from (select user_id, event_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as interval from events) where interval is not null")
add("time_gap", lambda t: sq.time_gap(t.events.select("user_id", "event_id", epoch_ms(t.events, "ts").alias("ms")), ["user_id"], "ms", "hour", ["event_id"]).drop("ms"),
    "select * from (select user_id, event_id, cast(floor(((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id)) / 3600000 + 0.5) as bigint) gap from events) where gap is not null")
add("time_gap_events", lambda t: sq.event_gap(t.events.select("user_id", "event_type", epoch_ms(t.events, "ts").alias("ms")), ["user_id"], "ms", "event_type", "view", "purchase", "min").select("user_id", "begin", "end", "gap"),
    """with b as (select user_id, min((epoch_us(ts) // 1000)) bb from events where event_type = 'view' group by 1) select user_id, bb as "begin", min((epoch_us(ts) // 1000)) as "end", cast(floor((min((epoch_us(ts) // 1000)) - bb) / 60000 + 0.5) as bigint) gap
    from events join b using (user_id) where event_type = 'purchase' and (epoch_us(ts) // 1000) > bb group by 1, 2""")  # fmt: skip

# Splits

add("split_filter", lambda t: r.split(t.orders, "filter", where="o_orderstatus eq F").selected.select("o_orderkey"), "select o_orderkey from orders where o_orderstatus = 'F'")
add("split_filter_complement", lambda t: r.split(t.orders, "filter", where="o_orderstatus eq F").remaining.select("o_orderkey"), "select o_orderkey from orders where o_orderstatus is distinct from 'F'")
add("split_missing", lambda t: r.split(_holes(t), "withMissingFields").selected.select("event_id"), f"with {_HOLES} select event_id from h where {_MISSES} > 0")
add("split_subsample", lambda t: r.split(t.orders, "subSample", fraction=0.2).selected.select("o_orderkey"))
add("range_partition_n", lambda t: r.range_partition(t.orders, "o_totalprice", n=10).select("o_orderkey", "range_index"),
    "with m as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, cast(least(floor((o_totalprice - lo) / (hi - lo) * 10), 9) as int) range_index from orders, m")
add("range_partition_boundaries", lambda t: r.range_partition(t.orders, "o_totalprice", boundaries=[50000, 150000, 300000]).select("o_orderkey", "range_index"),
    "select o_orderkey, (o_totalprice >= 50000)::int + (o_totalprice >= 150000)::int + (o_totalprice >= 300000)::int range_index from orders")

# Joins

_J = {"left": "customer", "right": "orders"}


def _join(t, **o):
    return r.join(t.customer, t.orders, ["c_custkey"], ["o_custkey"], ["c_name"], ["o_orderkey"], "c_nationkey lt 12", "o_orderstatus eq F", **o)


_JSQL = "select {key} key0, {c} c_name, {o} o_orderkey from (select * from customer where c_nationkey < 12) {how} join (select * from orders where o_orderstatus = 'F') on c_custkey = o_custkey"
_CN, _OK = "case when c_custkey is null then 'none' else c_name end", "case when o_custkey is null then 0 else o_orderkey end"
add("join_inner", _join, _JSQL.format(key="c_custkey", c="c_name", o="o_orderkey", how="inner"))
add("join_left_default", lambda t: _join(t, right_default=0), _JSQL.format(key="c_custkey", c="c_name", o=_OK, how="left"))
add("join_right_default", lambda t: _join(t, left_default="none"), _JSQL.format(key="o_custkey", c=_CN, o="o_orderkey", how="right"))
add("join_full_default", lambda t: _join(t, left_default="none", right_default=0, key_position="end"), _JSQL.format(key="coalesce(c_custkey, o_custkey)", c=_CN, o=_OK, how="full"))
_per_segment = lambda t: t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("most"))
add("join_composite", lambda t: r.join(t.customer, _per_segment(t), ["c_nationkey", "c_mktsegment"], ["c_nationkey", "c_mktsegment"], ["c_custkey", "c_acctbal"], ["n"], None, "most gt 9500", right_default=0),
    "select c_nationkey key0, c_mktsegment key1, c_custkey, c_acctbal, coalesce(n, 0) n from customer left join (select c_nationkey, c_mktsegment, count(*) n from customer group by all having max(c_acctbal) > 9500) using (c_nationkey, c_mktsegment)")
_ROLES = lambda t: {"n": (t.nation, "n_nationkey", ["n_name"], None), "c": (t.customer, "c_nationkey", ["c_name"], None), "s": (t.supplier, "s_nationkey", ["s_name"], None)}
add("multi_join_inner", lambda t: r.multi_join(_ROLES(t)), f"select n_nationkey as key, n_name n_n_name, c_name c_c_name, s_name s_s_name from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey")
add("multi_join_outer", lambda t: r.multi_join(_ROLES(t), outer=True), f"select n_nationkey as key, coalesce(n_name, '') n_n_name, coalesce(c_name, '') c_c_name, coalesce(s_name, '') s_s_name from nation left join customer on c_nationkey = n_nationkey left join supplier on s_nationkey = n_nationkey")
add("lookup_side_table", lambda t: r.lookup(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.nation.where("n_regionkey < 3"), "n_nationkey", "n_name", "nation").select("c_custkey", "nation"),
    "select c_custkey, coalesce(n_name, cast(c_nationkey as varchar)) nation from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3")
add("combinator_pairs", lambda t: r.combinator(t.part, ["p_brand", "p_type", "p_name"], "p_partkey"),
    """select p_partkey, least(a, b) "first", greatest(a, b) "second" from (select p_partkey, p_brand a, p_type b from part union all select p_partkey, p_brand, p_name from part union all select p_partkey, p_type, p_name from part)
    where a is not null and b is not null""")  # fmt: skip
add("kv_format", lambda t: r.format_key_values(t.lineitem, [("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")], ["l_suppkey"]),
    "select l_suppkey, kv_key, list_sort(list(v)) kv_values from (select l_suppkey, l_returnflag kv_key, l_linenumber v from lineitem union all select l_suppkey, l_linestatus, l_linenumber from lineitem) group by 1, 2")

# Set operations

_SA, _SB = "select c_custkey as k, c_mktsegment v from customer where c_acctbal < 5000", "select c_custkey as k, c_mktsegment v from customer where c_acctbal >= 0"
_sets = lambda t: tuple(t.customer.where(w).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")) for w in ("c_acctbal < 5000", "c_acctbal >= 0"))
for _op, _q in (("intersect", f"({_SA}) intersect ({_SB})"), ("union", f"({_SA}) union all ({_SB})"), ("firstMinusSecond", f"({_SA}) except ({_SB})"), ("secondMinusFirst", f"({_SB}) except ({_SA})")):
    add(f"set_key_{_op}", lambda t, o=_op: r.set_op(*_sets(t), o, ["k"]), _q)
# Keys that repeat: only those that occur exactly once count.
_open_and_done = lambda t: tuple(t.orders.where(w).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")) for w in ("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'", "o_orderstatus = 'F' and o_orderpriority = '2-HIGH'"))
_OD = "a as (select o_custkey as k, o_orderkey v from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'), b as (select o_custkey as k, o_orderkey v from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH')"
for _op, _q in (
    ("intersect", "select k, v from a where k in (select k from a group by k having count(*) = 1) and k in (select k from b group by k having count(*) = 1)"),
    ("firstMinusSecond", "select k, v from a where k in (select k from a group by k having count(*) = 1) and k not in (select k from b)"),
    ("secondMinusFirst", "select k, v from b where k in (select k from b group by k having count(*) = 1) and k not in (select k from a)"),
):
    add(f"set_repeated_key_{_op}", lambda t, o=_op: r.set_op(*_open_and_done(t), o, ["k"]), f"with {_OD} {_q}")
_values = lambda t: (t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v")), t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v")))
_VA = "a as (select c_nationkey k, list_sort(list(distinct c_mktsegment)) x from customer group by 1), b as (select c_nationkey k, list_sort(list(distinct c_mktsegment)) y from customer where c_acctbal < 0 group by 1), j as (select k, coalesce(x, []) x, coalesce(y, []) y from a full join b using (k))"
for _op, _q in (
    ("intersect", "list_sort(list_intersect(x, y))"), ("union", "list_concat(x[1:2], y[1:2])"), ("firstMinusSecond", "list_sort(list_filter(x, lambda e: not list_contains(y, e)))"), ("secondMinusFirst", "list_sort(list_filter(y, lambda e: not list_contains(x, e)))"),
):
    add(f"set_value_{_op}", lambda t, o=_op: r.set_op(*_values(t), o, ["k"], "v", "value", 4 if o == "union" else None), f"with {_VA} select k, {_q} v from j where len({_q}) > 0")

# De-duplication

_D = "select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) rn, count(*) over (partition by o_custkey, o_orderpriority) n from orders"
_dedup = lambda t, mode: r.dedup(t.orders, ["o_custkey", "o_orderpriority"], mode, order_by=["o_orderkey"])
add("dedup_all", lambda t: _dedup(t, "all").result.select("o_orderkey"), f"select o_orderkey from ({_D}) where rn = 1")
add("dedup_duplicate", lambda t: _dedup(t, "duplicate").result.select("o_orderkey"), f"select o_orderkey from ({_D}) where rn = 1 and n > 1")
add("dedup_unique", lambda t: _dedup(t, "unique").result.select("o_orderkey"), f"select o_orderkey from ({_D}) where n = 1")
add("dedup_members", lambda t: _dedup(t, "all").members.select("o_orderkey"), f"select o_orderkey from ({_D}) where n > 1")
add("dedup_keys_only", lambda t: r.dedup(t.orders, ["o_custkey", "o_orderpriority"], "duplicate", whole=False).result, "select o_custkey, o_orderpriority from orders group by 1, 2 having count(*) > 1")
add("dedup_whole_rows", lambda t: r.dedup(t.part.select("p_brand", "p_type", "p_size"), mode="unique").result, "select p_brand, p_type, p_size from part group by 1, 2, 3 having count(*) = 1")

# Mutation

_base = lambda t: t.orders.where("o_orderkey % 10 < 8").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("seq"))
_incr = lambda t: t.orders.where("o_orderkey % 10 > 5").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.expr("cast(o_orderkey % 3 as int)").alias("seq"))
_MB = "b as (select o_orderkey, o_custkey, o_totalprice, 1 seq, 0 nw from orders where o_orderkey % 10 < 8), i as (select o_orderkey, o_custkey, o_totalprice + 1 o_totalprice, cast(o_orderkey % 3 as int) seq, 1 nw from orders where o_orderkey % 10 > 5), u as (select *, row_number() over (partition by o_orderkey order by seq desc, nw desc) rn, count(*) over (partition by o_orderkey) n from (select * from b union all select * from i))"
_MC = "o_orderkey, o_custkey, o_totalprice, seq"
add("bulk_partial", lambda t: mu.bulk_mutate(_base(t), _incr(t), ["o_orderkey"], "seq").current, f"with {_MB} select {_MC} from u where rn = 1")
add("bulk_upsert", lambda t: mu.bulk_mutate(_base(t), _incr(t), ["o_orderkey"], "seq", op="upsert").current, f"with {_MB} select {_MC} from u where rn = 1")
add("bulk_full", lambda t: mu.bulk_mutate(_base(t), _incr(t), ["o_orderkey"], "seq", sync="full").current, f"with {_MB} select {_MC} from u where rn = 1 and o_orderkey in (select o_orderkey from i)")
add("bulk_delete", lambda t: mu.bulk_mutate(_base(t), _incr(t), ["o_orderkey"], "seq", op="delete").current, f"with {_MB} select {_MC} from b where o_orderkey not in (select o_orderkey from i)")
add("bulk_versions", lambda t: mu.bulk_mutate(_base(t), _incr(t), ["o_orderkey"], "seq").versions, f"with {_MB} select {_MC}, cast(rn as int) as version, rn = 1 is_current from u where n = 2")
add("bulk_eventlog", lambda t: mu.apply_event_log(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", "event_type", "error"),
    "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) rn from events) where rn = 1 and event_type <> 'error'")

QUERIES, SQL = registry.queries, registry.sql
