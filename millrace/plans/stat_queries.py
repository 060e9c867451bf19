"""Queries of statistics, histograms, fits, profiling, quality, normalisation, similarity and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.distance import Part
from millrace.functions.season import first_cycle, parent_index, season_index
from millrace.operators import extract as ex
from millrace.operators import histogram as hi
from millrace.operators import profile as pr
from millrace.operators import quality as qu
from millrace.operators import similarity as si
from millrace.operators import stats as st
from millrace.operators.common import epoch_ms, round_double
from millrace.plans.registry import Registry
from millrace.plans.relational_queries import _HOLES, _holes, _seconds

registry = Registry()
add = registry.add


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


# Moments, medians, running and temporal aggregates

_DIGITS = {"sum": 3, "sum_sq": 4, "mean": 9, "avg": 9, "variance": 6, "std_dev": 6}


def _moments(df):
    return df.withColumns({c: F.round(c, n) for c, n in _DIGITS.items() if c in df.columns})


def _m(v):
    return f"round(sum({v}), 3) as sum, round(sum({v} * {v}), 4) sum_sq, count({v}) as count, round(avg({v}), 9) mean, round(var_pop({v}), 6) variance, round(stddev_pop({v}), 6) std_dev, cast(min({v}) as double) as min, cast(max({v}) as double) as max"


_TWO = "select l_returnflag, l_linestatus, l_suppkey, unnest(['l_quantity', 'l_tax']) attr, unnest([l_quantity, l_tax]) v from lineitem"
add("num_stats", lambda t: _moments(st.numerical_stats(t.lineitem, ["l_quantity", "l_tax"], ["l_returnflag"])), f"select l_returnflag, attr, {_m('v')} from ({_TWO}) group by 1, 2")
add("num_stats_cond", lambda t: _moments(st.numerical_stats(t.lineitem, ["l_quantity", "l_tax"], ["l_returnflag"], cond="l_linestatus")), f"select l_returnflag, l_linestatus, attr, {_m('v')} from ({_TWO}) group by all")
add("num_stats_min_count", lambda t: _moments(st.numerical_stats(t.lineitem, ["l_quantity", "l_tax"], ["l_suppkey"], min_count=600)), f"select l_suppkey, attr, {_m('v')} from ({_TWO}) group by all having count(v) > 600")
_HOUR = "cast((epoch_us(ts) // 1000000 % 86400) // 3600 as bigint)"
add("num_stats_season", lambda t: _moments(st.numerical_stats(t.events, ["value"], ["event_type"], season=season_index(_seconds(t.events), "hourOfDay"))),
    f"select event_type, {_HOUR} season_index, 'value' attr, {_m('value')} from events group by all")
add("str_len_stats", lambda t: _moments(st.string_stats(t.part, ["p_name", "p_type"], ["p_brand"])),
    f"select p_brand, attr, {_m('v')} from (select p_brand, unnest(['p_name', 'p_type']) attr, unnest([length(p_name), length(p_type)])::double v from part) group by all")
add("median", lambda t: rounded(st.median_stats(t.events, ["value"], ["event_type"]), 4, "median"), "select event_type, 'value' attr, count(value) n, round(median(value), 4) median from events group by 1")
add("median_season", lambda t: rounded(st.median_stats(t.events, ["value"], ["event_type"], season=season_index(_seconds(t.events), "hourOfDay")), 4, "median"),
    f"select event_type, {_HOUR} season_index, 'value' attr, count(value) n, round(median(value), 4) median from events group by all")
add("mad", lambda t: rounded(st.median_stats(t.events, ["value"], ["event_type"], mad=True), 4, "mad"),
    "select event_type, 'value' attr, count(value) n, round(median(abs(value - m)) * 1.4296, 4) mad from events join (select event_type, median(value) m from events group by 1) using (event_type) group by 1")
_early = lambda: F.lit("2024-01-10").cast("timestamp_ntz")


def _running(t, **o):
    state = st.numerical_stats(t.events.where(F.col("ts") < _early()), ["value"], ["user_id"])
    return _moments(st.running_merge(state, t.events.where((F.col("ts") >= _early()) & (F.col("user_id") % 4 > 0)), ["user_id"], ["value"], **o))


_RUN = "round(sum(v), 3) as sum, round(sum(v * v), 4) sum_sq, round(avg(v), 9) as avg, round(stddev_pop(v), 6) std_dev"
_OLD, _NEW = "select user_id, value v from events where ts < '2024-01-10'", "select user_id, value v from events where ts >= '2024-01-10' and user_id % 4 > 0"
add("running_merge", _running, f"select user_id, 'value' attr, count(v) as count, {_RUN} from ({_OLD} union all {_NEW}) group by 1")
add("running_merge_zero", lambda t: _running(t, missing_as_zero=True),
    f"select user_id, 'value' attr, count(v) as count, {_RUN} from ({_OLD} union all {_NEW} union all select distinct user_id, 0.0 from ({_OLD}) where user_id not in (select user_id from ({_NEW}))) group by 1")
_B = "cast((epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 21600000 as bigint)"
for _f, _q in (("count", "count(value)"), ("sum", "round(sum(value), 6)"), ("average", "round(avg(value), 9)")):
    add(f"temporal_{_f}", lambda t, f=_f: st.temporal_aggregate(t.events, ["event_type"], epoch_ms(t.events, "ts"), ["value"], "hour", 6, f).withColumn(f, F.round(f, 9) if f == "average" else F.round(f, 6) if f == "sum" else F.col(f)),
        f"select event_type, {_B} bucket, 'value' attr, {_q} as \"{_f}\" from events group by all")
    add(f"seasonal_detect_{_f}",
        lambda t, f=_f: st.seasonal_aggregate(t.events, ["event_type"], ["value"], parent_index(_seconds(t.events), "hourOfDay"), season_index(_seconds(t.events), "sixHourOfDay"), f).withColumn(f, F.round(f, 9) if f == "average" else F.round(f, 6) if f == "sum" else F.col(f)),
        f"select event_type, cast(epoch_us(ts) // 86400000000 as bigint) parent_cycle, cast((epoch_us(ts) // 1000000 % 86400) // 21600 as bigint) cycle_index, 'value' attr, {_q} as \"{_f}\" from events group by all")
add("temporal_compact", lambda t: rounded(st.temporal_aggregate(t.lineitem, ["l_returnflag"], epoch_ms(t.lineitem, "l_shipdate"), ["l_quantity", "l_tax"], "week", 4, "sum", compact=True), 3, "sum_l_quantity", "sum_l_tax"),
    "select l_returnflag, cast(epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % 2419200000 as bigint) bucket, round(sum(l_quantity), 3) sum_l_quantity, round(sum(l_tax), 3) sum_l_tax from lineitem group by all")
_cycles = lambda t: t.events.withColumn("h", season_index(_seconds(t.events), "hourOfDay")).groupBy("event_type", "h").agg(F.count("*").alias("n"))
_CY = f"c as (select event_type, {_HOUR} h, count(*) n from events group by all)"
add("seasonal_cycles_topn", lambda t: st.seasonal_cycles(_cycles(t), ["event_type"], "h", "n", top_n=4), f"with {_CY} select event_type, h, n from (select *, row_number() over (partition by event_type order by n desc, h) k from c) where k <= 4")
add("seasonal_cycles_above_avg", lambda t: st.seasonal_cycles(_cycles(t), ["event_type"], "h", "n", pct_above=5), f"with {_CY} select event_type, h, n from (select *, avg(n) over (partition by event_type) m from c) where n > m * 1.05")
add("seasonal_cycles_entropy", lambda t: st.seasonal_cycles(_cycles(t), ["event_type"], "h", "n", top_n=2, max_entropy=3.1775),
    f"with {_CY}, e as (select event_type, -sum(p * ln(p)) e from (select event_type, n / sum(n) over (partition by event_type) p from c) group by 1) select event_type, h, n from (select *, row_number() over (partition by event_type order by n desc, h) k from c) where k <= 2 and event_type in (select event_type from e where e < 3.1775)")
add("temporal_rate", lambda t: st.temporal_rate(t.lineitem, F.col("l_linenumber"), F.col("l_quantity"), "hour", 86_400_000.0).select("l_orderkey", "l_linenumber", F.round("rate", 6).alias("rate")),
    "select l_orderkey, l_linenumber, round((l_quantity - l_linenumber) * 3600000.0 / 86400000.0, 6) rate from lineitem")
add("weighted_average", lambda t: st.weighted_average(t.part, {"p_size": 2, "p_retailprice": 1}, 100.0, {"p_size": 50.0, "p_retailprice": 2000.0}, invert=["p_retailprice"]).select("p_partkey", F.round("score", 5).alias("score")),
    "select p_partkey, round((2 * (p_size * 100.0 / 50.0) + (100.0 - p_retailprice * 100.0 / 2000.0)) / 3, 5) score from part")


def _ranks(t):
    by = [("price", F.col("p_retailprice")), ("size", F.col("p_size").cast("double")), ("name", F.length("p_name").cast("double"))]
    from pyspark.sql import Window

    one = [t.part.select("p_partkey", F.lit(n).alias("source"), F.rank().over(Window.partitionBy("p_brand").orderBy(c)).alias("r")) for n, c in by]
    return one[0].unionAll(one[1]).unionAll(one[2])


_RK = "r as (select p_partkey, 'price' source, rank() over (partition by p_brand order by p_retailprice) r from part union all select p_partkey, 'size', rank() over (partition by p_brand order by p_size) from part union all select p_partkey, 'name', rank() over (partition by p_brand order by length(p_name)) from part)"
for _h, _q in (("average", "avg(r)"), ("weightedAverage", "sum(r * case source when 'price' then 3 when 'size' then 2 else 1 end) / sum(case source when 'price' then 3 when 'size' then 2 else 1 end)"), ("median", "median(r)"), ("max", "max(r)"), ("product", "exp(avg(ln(r)))")):
    add(f"rank_{_h}", lambda t, h=_h: rounded(st.aggregate_ranks(_ranks(t), "p_partkey", "source", "r", h, {"price": 3, "size": 2, "name": 1}), 5, "merged_rank"), f"with {_RK} select p_partkey, round(cast({_q} as double), 5) merged_rank from r group by 1")

# Correlation and covariance

_daily = lambda t: t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("x"), F.count("*").cast("double").alias("y"))
_DY = "d as (select event_type, cast(ts as date) as day, round(sum(value), 2) x, count(*)::double y from events group by all)"
_AC = f"with {_DY}, m as (select event_type, day, x - avg(x) over (partition by event_type) d from d), l as (select event_type, d, lag(d, 1) over w l1, lag(d, 2) over w l2, lag(d, 7) over w l7 from m window w as (partition by event_type order by day)), s as (select event_type, sum(d * d) v, sum(d * l1) c1, sum(d * l2) c2, sum(d * l7) c7 from l group by 1), a as (select event_type, 'x' attr, unnest([1, 2, 7]) lag, unnest([c1 / v, c2 / v, c7 / v]) correlation from s)"
add("autocorr", lambda t: rounded(st.autocorrelation(_daily(t), ["event_type"], "day", ["x"], [1, 2, 7]), 6, "correlation"), f"{_AC} select event_type, attr, lag, round(correlation, 6) correlation from a")
add("autocorr_max", lambda t: rounded(st.autocorrelation(_daily(t), ["event_type"], "day", ["x"], [1, 2, 7], max_only=True), 6, "correlation"), f"{_AC} select event_type, attr, arg_max(lag, correlation) lag, round(max(correlation), 6) correlation from a group by 1, 2")
add("crosscorr", lambda t: rounded(st.crosscorrelation(_daily(t), ["event_type"], "day", [("x", "y")], [-1, 0, 1]), 6, "correlation"),
    f"with {_DY}, z as (select event_type, day, (x - avg(x) over p) / stddev_pop(x) over p x, (y - avg(y) over p) / stddev_pop(y) over p y from d window p as (partition by event_type)), l as (select event_type, x * lead(y) over w a, x * y b, x * lag(y) over w c from z window w as (partition by event_type order by day)), s as (select event_type, count(*) n, sum(a) a, sum(b) b, sum(c) c from l group by 1) select event_type, 'x' attr1, 'y' attr2, unnest([-1, 0, 1]) lag, round(unnest([a / n, b / n, c / n]), 6) correlation from s")
_CV = "select l_returnflag, avg(l_quantity) a, avg(l_extendedprice) b, covar_pop(l_quantity, l_quantity) aa, covar_pop(l_quantity, l_extendedprice) ab, covar_pop(l_extendedprice, l_extendedprice) bb from lineitem group by 1"
add("covariance", lambda t: rounded(st.covariance(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"]), 2, "mean1", "mean2", "covariance"),
    f"select l_returnflag, unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) attr1, unnest(['l_quantity', 'l_extendedprice', 'l_extendedprice']) attr2, round(unnest([a, a, b]), 2) mean1, round(unnest([a, b, b]), 2) mean2, round(unnest([aa, ab, bb]), 2) covariance from ({_CV})")
add("mahalanobis", lambda t: st.mahalanobis(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("mahalanobis", 4).alias("mahalanobis")),
    f"select l_orderkey, l_linenumber, l_partkey, round(sqrt(((l_quantity - a) * (l_quantity - a) * bb - 2 * (l_quantity - a) * (l_extendedprice - b) * ab + (l_extendedprice - b) * (l_extendedprice - b) * aa) / (aa * bb - ab * ab)), 4) mahalanobis from lineitem join ({_CV}) using (l_returnflag)")
add("covariance_season", lambda t: rounded(st.covariance(t.events.withColumn("user", F.col("user_id").cast("double")), ["value", "user"], ["event_type"], season=season_index(_seconds(t.events), "sixHourOfDay")), 3, "mean1", "mean2", "covariance"),
    """with s as (select event_type, cast((epoch_us(ts) // 1000000 % 86400) // 21600 as bigint) season_index, avg(value) a, avg(user_id) b, covar_pop(value, value) aa, covar_pop(value, user_id) ab, covar_pop(user_id, user_id) bb from events group by all)
    select event_type, season_index, unnest(['value', 'value', 'user']) attr1, unnest(['value', 'user', 'user']) attr2, round(unnest([a, a, b]), 3) mean1, round(unnest([a, b, b]), 3) mean2, round(unnest([aa, ab, bb]), 3) covariance from s""")  # fmt: skip
add("mahalanobis_saved", lambda t: st.mahalanobis(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"], saved=st.covariance(t.lineitem.where("l_linestatus = 'F'"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])).select("l_orderkey", "l_linenumber", "l_partkey", F.round("mahalanobis", 4).alias("mahalanobis")),
    f"select l_orderkey, l_linenumber, l_partkey, round(sqrt(((l_quantity - a) * (l_quantity - a) * bb - 2 * (l_quantity - a) * (l_extendedprice - b) * ab + (l_extendedprice - b) * (l_extendedprice - b) * aa) / (aa * bb - ab * ab)), 4) mahalanobis from lineitem left join ({_CV.replace('lineitem', 'lineitem where l_linestatus = ' + chr(39) + 'F' + chr(39))}) using (l_returnflag)")
add("norm_saved_stats", lambda t: rounded(qu.normalize(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_quantity"], "zScore", keys=["l_returnflag"], stats=st.numerical_stats(t.lineitem.where("l_linestatus = 'F'"), ["l_quantity"], ["l_returnflag"])), 6, "l_quantity"),
    "select l_orderkey, l_linenumber, l_returnflag, round((l_quantity - m) / s, 6) l_quantity from lineitem left join (select l_returnflag, avg(l_quantity) m, stddev_pop(l_quantity) s from lineitem where l_linestatus = 'F' group by 1) using (l_returnflag)")
add("moving_average", lambda t: st.moving_average(_daily(t), ["event_type"], "day", "x", 6).select("event_type", "day", F.round("moving_average", 4).alias("moving_average")),
    f"with {_DY} select event_type, day, round(avg(x) over (partition by event_type order by day rows between 6 preceding and current row), 4) moving_average from d")
add("regression", lambda t: rounded(st.regression(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice"), 4, "slope", "intercept", "r2"),
    "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 4) r2 from lineitem group by 1")
add("loess", lambda t: st.loess(_daily(t), ["event_type"], "day", "x", 7).select("event_type", "day", F.round("smooth", 4).alias("smooth")),
    f"""with {_DY}, n as (select event_type, day, x, row_number() over (partition by event_type order by day) i from d),
    p as (select a.event_type, a.day, b.i - a.i u, b.x v, pow(1 - pow(abs(b.i - a.i) / 4, 3), 3) w from n a join n b on a.event_type = b.event_type and abs(b.i - a.i) <= 3),
    s as (select event_type, day, sum(w) w, sum(w * u) u, sum(w * v) v, sum(w * u * u) uu, sum(w * u * v) uv from p group by all)
    select event_type, day, round((uu * v - u * uv) / (w * uu - u * u), 4) smooth from s""")  # fmt: skip
add("ewma", lambda t: st.ewma(_daily(t), ["event_type"], "day", "x", 0.3).select("event_type", "day", F.round("ewma", 2).alias("ewma")),
    f"""with recursive {_DY}, n as (select event_type, day, x, row_number() over (partition by event_type order by day) i from d),
    e as (select event_type, day, i, x e from n where i = 1 union all select n.event_type, n.day, n.i, e.e + 0.3 * (n.x - e.e) from n join e on n.event_type = e.event_type and n.i = e.i + 1)
    select event_type, day, round(e, 2) ewma from e""")  # fmt: skip

# Histograms and fits

_hist = lambda t, keys=("l_returnflag",): hi.numeric_histogram(t.lineitem, ["l_extendedprice"], {"l_extendedprice": 7000.0}, keys)
_H = "h as (select l_returnflag, 'l_extendedprice' attr, 7000.0::double width, cast(trunc(l_extendedprice / 7000) as int) bin, count(*) as count, sum(l_extendedprice) as sum, sum(l_extendedprice * l_extendedprice) sum_sq from lineitem group by all)"
add("hist_numeric", lambda t: rounded(_hist(t), 1, "sum").drop("sum_sq"), f"with {_H} select l_returnflag, attr, width, bin, count, round(sum, 1) as sum from h")
_widths = lambda t: t.lineitem.groupBy("l_returnflag").agg(F.lit("l_quantity").alias("attr"), (F.round(F.stddev_pop("l_quantity"), 1) / 2).alias("width"))
add("hist_perkey_width", lambda t: rounded(hi.numeric_histogram(t.lineitem, ["l_quantity"], _widths(t), ["l_returnflag"]), 1, "sum", "sum_sq"),
    "with w as (select l_returnflag, round(stddev_pop(l_quantity), 1) / 2 width from lineitem group by 1) select l_returnflag, 'l_quantity' attr, width, cast(trunc(l_quantity / width) as int) bin, count(*) as count, round(sum(l_quantity), 1) as sum, round(sum(l_quantity * l_quantity), 1) sum_sq from lineitem join w using (l_returnflag) group by all")
add("hist_season", lambda t: _moments(hi.numeric_histogram(t.events, ["value"], {"value": 20.0}, ["event_type"], season=season_index(_seconds(t.events), "weekDayOrWeekendOfWeek"))),
    "select event_type, cast(case when (epoch_us(ts) // 1000000 % 604800) // 86400 < 5 then 0 else 1 end as bigint) season_index, 'value' attr, 20.0::double width, cast(trunc(value / 20) as int) bin, count(*) as count, round(sum(value), 3) as sum, round(sum(value * value), 4) sum_sq from events group by all")
_SUM = f"""with {_H}, t as (select l_returnflag, sum(count) n, sum(sum) s, sum(sum_sq) q from h group by 1),
 c as (select h.*, n, sum(count) over (partition by l_returnflag order by bin) cum from h join t using (l_returnflag)),
 z as (select l_returnflag, {", ".join(f"min(case when cum >= n * {p} and cum - count < n * {p} then bin * width + width * (n * {p} - (cum - count)) / count end) q{round(p * 100)}" for p in (0.25, 0.5, 0.75))}, -sum(count / n * ln(count / n)) entropy from c group by 1),
 o as (select l_returnflag, bin * width + width / 2 as md from (select *, row_number() over (partition by l_returnflag order by count desc, bin) k from h) where k = 1)"""
add("hist_quantiles", lambda t: rounded(hi.summary(_hist(t), ["l_returnflag"]).drop("mode", "entropy"), 3, "mean", "std_dev", "q25", "q50", "q75"),
    f"{_SUM} select l_returnflag, cast(n as bigint) as count, round(s / n, 3) mean, round(sqrt((q - s * s / n) / (n - 1)), 3) std_dev, round(q25, 3) q25, round(q50, 3) q50, round(q75, 3) q75 from t join z using (l_returnflag)")
add("hist_entropy_mode", lambda t: rounded(hi.summary(_hist(t), ["l_returnflag"]).select("l_returnflag", "mode", "entropy"), 5, "entropy"), f"{_SUM} select l_returnflag, md as mode, round(entropy, 5) entropy from z join o using (l_returnflag)")
add("hist_joint", lambda t: hi.joint_histogram(t.lineitem, {"l_quantity": 10.0, "l_discount": 0.025, "l_linestatus": None}, ["l_returnflag"]),
    "select l_returnflag, cast(trunc(l_quantity / 10) as int) l_quantity_bin, cast(trunc(l_discount / 0.025::double) as int) l_discount_bin, l_linestatus l_linestatus_bin, count(*) as count from lineitem group by all")
add("hist_tagged", lambda t: hi.tag_bins(t.lineitem, {"l_quantity": 10.0, "l_extendedprice": 7000.0}).select("l_orderkey", "l_linenumber", "bin_key"),
    "select l_orderkey, l_linenumber, cast(trunc(l_quantity / 10) as int) || ':' || cast(trunc(l_extendedprice / 7000) as int) bin_key from lineitem")
add("hist_prebinned", lambda t: hi.prebinned(t.lineitem, ["l_returnflag"], "l_linenumber", "l_suppkey"), "select l_returnflag, l_linenumber bin, cast(sum(l_suppkey) as bigint) as count from lineitem group by all")
add("hist_merge", lambda t: hi.merge(_hist(t).drop("l_returnflag", "sum", "sum_sq"), _hist(t).drop("l_returnflag", "sum", "sum_sq"), by=["attr", "width", "bin"]),
    f"with {_H} select attr, width, bin, cast(2 * sum(count) as bigint) as count from h group by all")
add("hist_meta", lambda t: rounded(hi.meta_distribution(_hist(t), ["l_returnflag"]), 6, "at_most_share"), f"with {_H} select a.l_returnflag, a.bin, round(sum(b.count) / any_value(n), 6) at_most_share from h a join h b on a.l_returnflag = b.l_returnflag and b.count <= a.count join (select l_returnflag, sum(count) n from h group by 1) c on c.l_returnflag = a.l_returnflag group by 1, 2")
add("hist_confidence", lambda t: hi.confidence_bounds(_hist(t), ["l_returnflag"], 60),
    f"with {_H}, m as (select l_returnflag, sum(sum) / sum(count) m, sum(count) n from h group by 1), x as (select h.*, n, sum(count) over (partition by l_returnflag order by abs((bin + 0.5) * width - m), bin rows between unbounded preceding and 1 preceding) b from h join m using (l_returnflag)) select l_returnflag, min(bin * width) low, max((bin + 1) * width) high from x where coalesce(b, 0) < n * 0.6 group by 1")
add("hist_equal_probability", lambda t: hi.equal_probability_bins(t.events, "value", 4, ["event_type"]).select("event_type", F.transform("boundaries", lambda b: F.round(b, 4)).alias("boundaries")),
    "select event_type, list_transform(quantile_cont(value, [0.25, 0.5, 0.75]), lambda b: round(b, 4)) boundaries from events group by 1")
add("hist_sliding", lambda t: hi.sliding_histogram(_daily(t), ["event_type"], "day", "y", 5.0, 7).select("event_type", "day", F.to_json("histogram").alias("histogram")),
    f"""with {_DY}, n as (select *, row_number() over (partition by event_type order by day) i from d), b as (select a.event_type, a.day, cast(trunc(b.y / 5) as int) bin, count(*) c from n a join n b on a.event_type = b.event_type and b.i between a.i - 6 and a.i group by all)
    select event_type, day, '[' || string_agg('{{"bin":' || bin || ',"count":' || c || '}}', ',' order by bin) || ']' histogram from b group by all""")  # fmt: skip
add("cat_distr", lambda t: rounded(hi.categorical_distribution(t.orders, ["o_orderpriority"], ["o_orderstatus"], global_row=True), 6, "share"),
    "select *, round(count / sum(count) over (partition by o_orderstatus, attr), 6) as share from (select o_orderstatus, 'o_orderpriority' attr, o_orderpriority as value, count(*) as count from orders group by all union all select '*', 'o_orderpriority', o_orderpriority, count(*) from orders group by all)")
_CD = "c as (select o_orderstatus, 'o_orderpriority' attr, o_orderpriority v, count(*) n from orders group by all), s as (select *, n / sum(n) over (partition by o_orderstatus) p, row_number() over (partition by o_orderstatus order by n desc, v) k from c)"
_cd = lambda t: hi.categorical_distribution(t.orders, ["o_orderpriority"], ["o_orderstatus"])
add("cat_distr_entropy_gini", lambda t: rounded(hi.categorical_summary(_cd(t), ["o_orderstatus", "attr"]), 6, "entropy", "gini"),
    f"with {_CD} select o_orderstatus, attr, cast(sum(n) as bigint) as count, max(v) filter (k = 1) as mode, round(-sum(p * ln(p)), 6) entropy, round(1 - sum(p * p), 6) gini from s group by 1, 2")
add("cat_confidence_set", lambda t: rounded(hi.confidence_set(_cd(t), ["o_orderstatus", "attr"], 50), 6, "share"),
    f"with {_CD}, x as (select *, sum(p) over (partition by o_orderstatus order by n desc, v rows between unbounded preceding and 1 preceding) b from s) select o_orderstatus, attr, v as value, n as count, round(p, 6) as share from x where coalesce(b, 0) < 0.5")
add("cat_class_distr", lambda t: hi.class_distribution(t.documents, ["lang", "licence_file"], "source").where("value is not null and class is not null"),
    "select attr, v as value, source as class, count(*) as count from (select source, unnest(['lang', 'licence_file']) attr, unnest([lang, licence_file]) v from documents) where v is not null and source is not null group by all")
add("cat_vdm", lambda t: rounded(hi.value_difference(t.orders, ["o_orderpriority"], "o_orderstatus", 2), 8, "distance"),
    """with n as (select o_orderpriority v, o_orderstatus k, count(*) n from orders group by all), c as (select v, k, n / sum(n) over (partition by v) p from n)
    select 'o_orderpriority' attr, a.v value1, b.v value2, round(sum(pow(a.p - b.p, 2)), 8) distance from c a join c b on a.k = b.k and a.v < b.v group by all""")  # fmt: skip
_two = lambda t: (_hist(t).where("l_returnflag <> 'R'"), hi.numeric_histogram(t.lineitem.where("l_returnflag = 'R'"), ["l_extendedprice"], {"l_extendedprice": 7000.0}))
_FIT = f"{_H}, f as (select a.l_returnflag, bin, coalesce(h.count, 0) a, coalesce(r.count, 0) b from (select l_returnflag, bin from (select distinct l_returnflag from h where l_returnflag <> 'R'), (select distinct bin from h)) a left join h using (l_returnflag, bin) left join (select bin, count from h where l_returnflag = 'R') r using (bin) where h.count is not null or r.count is not null), s as (select *, sum(a) over p na, sum(b) over p nb, sum(a) over w ca, sum(b) over w cb from f window p as (partition by l_returnflag), w as (partition by l_returnflag order by bin))"
add("fit_ks", lambda t: rounded(hi.kolmogorov_smirnov(*_two(t), ["l_returnflag"]), 6, "ks"), f"with {_FIT} select l_returnflag, round(max(abs(ca / na - cb / nb)), 6) ks from s group by 1")
add("fit_kl", lambda t: rounded(hi.kullback_leibler(*_two(t), ["l_returnflag"]), 6, "kl"), f"with {_FIT} select l_returnflag, round(sum(case when a > 0 and b > 0 then a / na * ln((a / na) / (b / nb)) end) / sum(case when a > 0 and b > 0 then a / na end), 6) kl from s group by 1")
add("fit_chi2_ref", lambda t: hi.chi_square_reference(*_two(t), ["l_returnflag"]).select("l_returnflag", F.round("chi_square", 4).alias("chi_square"), "degrees"),
    f"with {_FIT}, g as (select l_returnflag, case when b = 0 then a + 1 else a end a, greatest(b, 1) b from s), e as (select *, b * sum(a) over p / sum(b) over p e from g window p as (partition by l_returnflag)) select l_returnflag, round(sum((a - e) * (a - e) / e), 4) chi_square, cast(count(*) - 3 as int) degrees from e group by 1")
_PHI = "case when {z} >= 0 then 1 - {u} else {u} end"
_UP = "exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"


def _phi(z):
    return _PHI.format(z=z, u=_UP.format(z=z, t=f"(1 / (1 + 0.2316419 * abs({z})))"))


def _normal_fit(moments):
    """SQL of chi square against a normal distribution; ``moments``: expressions of mean and deviation over window g."""
    return f"""with {_H}, m as (select l_returnflag, bin, width, count c, sum(count) over g n, {moments} from h window g as (partition by l_returnflag)),
    e as (select l_returnflag, c, greatest(n * ({_phi("(((bin + 1) * width - mu) / sd)")} - {_phi("((bin * width - mu) / sd)")}), 1e-9) e from m), k as (select l_returnflag, sum((c - e) * (c - e) / e) x, greatest(count(*) - 3, 1) d from e group by 1),
    r as (select l_returnflag, x, d, d * pow(1 - 2.0 / (9 * d) + 1.6448536269514722 * sqrt(2.0 / (9 * d)), 3) v from k) select l_returnflag, round(x, 3) chi_square, cast(d as int) degrees, round(v, 3) critical, x < v fitted from r"""


add("fit_chi2_normal", lambda t: rounded(hi.chi_square_normal(_hist(t), ["l_returnflag"]), 3, "chi_square", "critical"), _normal_fit("sum(sum) over g / n mu, sqrt((sum(sum_sq) over g - n * mu * mu) / (n - 1)) sd"))
add("fit_chi2_given", lambda t: rounded(hi.chi_square_normal(_hist(t), ["l_returnflag"], mean=38000.0, std_dev=23000.0), 3, "chi_square", "critical"), _normal_fit("38000.0::double mu, 23000.0::double sd"))

# Profiling counters

add("unique_values", lambda t: pr.unique_values(t.part, ["p_brand", "p_type"], ignore_case=True), "select 'p_brand' attr, lower(p_brand) as value from part union select 'p_type', lower(p_type) from part")
add("unique_count", lambda t: pr.unique_count(t.part, ["p_type", "p_size"], ["p_brand"]), "select p_brand, unnest(['p_type', 'p_size']) attr, unnest([count(distinct p_type), count(distinct p_size)]) unique_values from part group by 1")
add("unique_completeness", lambda t: pr.unique_count(t.part, ["p_brand"], (), {"p_brand": 40}), "select 'p_brand' attr, count(distinct p_brand) unique_values, count(distinct p_brand) / 40 completeness from part")
add("unique_typed", lambda t: pr.unique_count(t.lineitem, ["l_discount"], ["l_returnflag"], kind="double"), "select l_returnflag, 'l_discount' attr, count(distinct l_discount) unique_values from lineitem group by 1")
add("unique_composite", lambda t: pr.composite_count(t.part, ["p_brand", "p_type"]), "select p_brand, p_type, count(*) as count from part group by all")
add("unique_key_violations", lambda t: pr.unique_key_violations(t.lineitem, ["l_orderkey", "l_linenumber"]), "select l_orderkey, l_linenumber, count(*) as count from lineitem group by all having count(*) > 1")
add("value_count", lambda t: pr.value_count(t.part, {"p_type": ["Small", "LARGE"], "p_brand": ["brand#7"]}, ignore_case=True),
    "select attr, v as value, count(*) as count from (select unnest(['p_type', 'p_brand']) attr, unnest([lower(p_type), lower(p_brand)]) v from part) where (attr = 'p_type' and v in ('small', 'large')) or v = 'brand#7' group by all")
add("pattern_count", lambda t: pr.pattern_count(t.part, {"p_brand": ["Brand#1.", "Brand#\\d"], "p_name": ["[a-z]+ ring"]}),
    "select unnest(['p_brand', 'p_brand', 'p_name']) attr, unnest(['Brand#1.', 'Brand#\\d', '[a-z]+ ring']) pattern, unnest([count(*) filter (regexp_full_match(p_brand, 'Brand#1.')), count(*) filter (regexp_full_match(p_brand, 'Brand#\\d')), count(*) filter (regexp_full_match(p_name, '[a-z]+ ring'))]) as count from part")
_TK = "select unnest(string_split(p_name, ' ')) token, unnest(generate_series(0, len(string_split(p_name, ' ')) - 1)) position from part"
add("token_count", lambda t: pr.token_count(t.part, "p_name", " ", min_count=10), f"select token, count(*) as count from ({_TK}) where token <> '' group by 1 having count(*) > 10")
add("token_count_pos", lambda t: pr.token_count(t.part, "p_name", " ", position=True), f"select token, cast(position as int) as position, count(*) as count from ({_TK}) where token <> '' group by all")
add("token_count_documents", lambda t: pr.token_count(t.documents, "text", "[^A-Za-z0-9_]+", min_count=20), "select token, count(*) as count from (select unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) token from documents) where token <> '' group by 1 having count(*) > 20")
add("func_dependency", lambda t: pr.functional_dependency(t.part, [("p_brand", "p_type"), ("p_partkey", "p_brand")]),
    "select 'p_brand' source, 'p_type' target, p_brand source_value, count(distinct p_type) target_values from part group by 3 union all select 'p_partkey', 'p_brand', cast(p_partkey as varchar), count(distinct p_brand) from part group by 3")
_MISSES = "((event_type is null or event_type = '')::int + (value is null)::int + (props is null or props = '')::int)"
add("missing_row", lambda t: pr.missing_counts(_holes(t), "row", "event_id"), f"with {_HOLES} select event_id, cast({_MISSES} as bigint) missing from h where {_MISSES} > 0")
add("missing_col", lambda t: pr.missing_counts(_holes(t), "col", "event_id"), f"with {_HOLES} select unnest(['event_type', 'value', 'props']) attr, unnest([count(*) filter (event_type is null), count(*) filter (value is null), count(*) filter (props is null or props = '')]) missing from h")
add("missing_distr", lambda t: pr.missing_counts(_holes(t), "distr", "event_id"), f"with {_HOLES} select cast({_MISSES} as bigint) missing, count(*) as rows from h group by 1")
_typed = lambda t: t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.concat(F.lit("USD "), F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("m"), (F.col("o_custkey") % 90).cast("string").alias("age"), F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 2).cast("string").alias("b"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("x"))
add("type_inference", lambda t: pr.infer_types(_typed(t), ["k", "d", "m", "age", "s", "b", "x"]).select("attr", "data_type", "matched"),
    "select unnest(['k', 'd', 'm', 'age', 's', 'b', 'x']) attr, unnest(['int', 'date', 'monetaryAmount', 'age', 'categorical', 'numericBoolean', 'string']) data_type, unnest([n, n, n, n, n, n, n]) matched from (select count(*) n from orders)")

# Quality

add("metric_completeness_row", lambda t: qu.completeness_rows(_holes(t), {"event_type": 2, "value": 1, "props": 1}).select("event_id", "complete_fields", "completeness"),
    f"with {_HOLES} select event_id, 3 - {_MISSES} complete_fields, (2 * (event_type is not null)::int + (value is not null)::int + (props <> '')::int) / 4 completeness from h")
add("metric_completeness_col", lambda t: rounded(qu.completeness_columns(_holes(t), ["event_type", "value", "props"]), 6, "fraction"),
    f"with {_HOLES}, s as (select count(*) n, count(event_type) a, count(value) b, count(*) filter (props <> '') c from h) select unnest(['event_type', 'value', 'props']) attr, unnest([a, b, c]) present, round(unnest([a / n, b / n, c / n]), 6) fraction from s")
_PROFILES = {"shape": {"event_type": 1, "value": 3}, "text": {"props": 1, "event_type": 1}}
_Q = f"{_HOLES}, q as (select event_id, event_type, value, ((event_type is not null)::int + 3 * (value is not null)::int) / 4 a, ((props <> '')::int + (event_type is not null)::int) / 2 b from h)"
add("metric_quality", lambda t: qu.quality_rows(_holes(t), _PROFILES).select("event_id", "quality_shape", "quality_text"), f"with {_Q} select event_id, a quality_shape, b quality_text from q")
add("metric_quality_col", lambda t: rounded(qu.quality_columns(_holes(t), _PROFILES), 6, "score"), f"with {_Q} select unnest(['shape', 'text']) as profile, round(unnest([avg(a), avg(b)]), 6) score from q")
add("metric_aggregate", lambda t: qu.aggregate_quality(qu.quality_rows(_holes(t), _PROFILES), {"quality_shape": 2, "quality_text": 1}).select("event_id", F.round("quality", 6).alias("quality")), f"with {_Q} select event_id, round((2 * a + b) / 3, 6) quality from q")
add("filter_by_quality", lambda t: qu.filter_by_quality(qu.quality_rows(_holes(t), _PROFILES), {"shape": 0.5, "text": 0.9})["shape"].select("event_id"), f"with {_Q} select event_id from q where a > 0.5")
_copy = lambda t: t.customer.where("c_custkey % 7 > 0").select("c_custkey", F.expr("case when c_custkey % 4 = 0 then lower(c_name) else c_name end").alias("c_name"), F.expr("case when c_custkey % 5 = 0 then null else c_mktsegment end").alias("c_mktsegment"))
add("metric_accuracy", lambda t: rounded(qu.accuracy(t.customer.select("c_custkey", "c_name", "c_mktsegment"), _copy(t), ["c_custkey"], {"c_name": 2, "c_mktsegment": 1}), 6, "accuracy"),
    """select c_custkey, c_name, c_mktsegment, case when c_custkey % 7 = 0 then 0 else (c_custkey % 4 > 0)::int + (c_custkey % 5 > 0)::int end matched_fields,
    case when c_custkey % 7 = 0 then -0.001 else round((2 * (c_custkey % 4 > 0)::int + (c_custkey % 5 > 0)::int) / 3, 6) end accuracy from customer""")  # fmt: skip


def _neighbours(t):
    p = t.part.select("p_partkey", "p_brand", "p_size", "p_type")
    a, b = p.select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").alias("own")), p.select(F.col("p_partkey").alias("nid"), F.col("p_brand").alias("nb"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    near = F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)]))
    return a.withColumn("step", near).withColumn("nid", F.col("id") + F.col("step")).join(b, "nid").withColumn("distance", F.abs(F.col("own") - F.col("size")) + 1)


_NB = "n as (select a.p_partkey id, a.p_brand, b.p_brand nb, b.p_size as size, b.p_type as type, abs(a.p_size - b.p_size) + 1 distance from part a, (values (-2), (-1), (1), (2)) s(step) join part b on b.p_partkey = a.p_partkey + step), w as (select *, pow(1 / distance, 2) w from n)"
add("impute_expectation", lambda t: rounded(qu.impute_nn(_neighbours(t), "id", {"size": "numeric"}, "distance", 2.0), 6, "imputed_size"), f"with {_NB} select id, round(sum(w * size) / sum(w), 6) imputed_size from w group by 1")
add("impute_mode", lambda t: qu.impute_nn(_neighbours(t), "id", {"type": "categorical"}, "distance", 0.0), f"with {_NB}, v as (select id, type, count(*) c from n group by all) select id, type imputed_type from (select *, row_number() over (partition by id order by c desc, type) k from v) where k = 1")
add("impute_same_class", lambda t: rounded(qu.impute_nn(_neighbours(t), "id", {"size": "numeric"}, "distance", 2.0, same_class=("p_brand", "nb"), min_neighbours=2), 6, "imputed_size"),
    f"with {_NB} select id, round(sum(w * size) / sum(w), 6) imputed_size from w where p_brand = nb group by 1 having count(*) >= 2")
add("impute_sample", lambda t: qu.impute_nn(_neighbours(t), "id", {"type": "categorical"}, "distance", 2.0, strategy="sample"))

_X = "l_extendedprice"
_norm = lambda t, s, digits=7, **o: rounded(qu.normalize(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", _X), [_X], s, **o), digits, _X)
_Z = f"({_X} - m) / s"
for _n, _o, _q in (
    ("minmax", {"strategy": "minMax"}, f"({_X} - lo) / (hi - lo)"), ("max", {"strategy": "max"}, f"{_X} / hi"), ("zscore", {"strategy": "zScore"}, _Z), ("zscore_trunc", {"strategy": "zScore", "trunc": 1.5}, f"(greatest(least({_Z}, 1.5), -1.5) + 1.5) / 3"),
    ("center", {"strategy": "center"}, f"{_X} - m"), ("decimal", {"strategy": "decimal"}, f"{_X} / pow(10, floor(log10(hi)) + 1)"), ("unitsum", {"strategy": "unitSum", "scale": 1000.0}, f"{_X} / t * 1000"),
    ("inverse", {"strategy": "minMax", "pre": "multiplicativeInverse"}, f"(1 / {_X} - 1 / hi) / (1 / lo - 1 / hi)"), ("additive_inverse", {"strategy": "minMax", "pre": "additiveInverse"}, f"(hi - {_X}) / (hi - lo)"),
):
    _d = {"center": 3, "decimal": 11}.get(_n, 7)
    add(f"norm_{_n}", lambda t, o=dict(_o), d=_d: _norm(t, o["strategy"], d, **{k: v for k, v in o.items() if k != "strategy"}),
        f"with g as (select min({_X}) lo, max({_X}) hi, avg({_X}) m, stddev_pop({_X}) s, sum({_X}) t from lineitem) select l_orderkey, l_linenumber, l_partkey, round({_q}, {_d}) {_X} from lineitem, g")
add("norm_zscore_drop", lambda t: _norm(t, "zScore", trunc=1.5, unit_range=False, drop_outliers=True), f"with g as (select avg({_X}) m, stddev_pop({_X}) s from lineitem) select l_orderkey, l_linenumber, l_partkey, round({_Z}, 7) {_X} from lineitem, g where abs({_Z}) <= 1.5")

# Similarity

_sup = lambda t: t.supplier.join(t.nation, t.supplier.s_nationkey == t.nation.n_nationkey).select("s_suppkey", "s_nationkey", "s_acctbal", F.col("n_regionkey").alias("region"), "s_name")
_SUP = "s as (select s_suppkey, s_nationkey, s_acctbal, n_regionkey region, s_name from supplier join nation on n_nationkey = s_nationkey)"
_PAIR = "from s a join s b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey"
_near = lambda pairs, digits: pairs.withColumn("distance", round_double(F.col("distance"), digits))
_sim = lambda t, parts, **o: _near(si.record_similarity(_sup(t), "s_suppkey", parts, block="s_nationkey", **o), 9)
add("sim_numeric", lambda t: _sim(t, [Part("s_acctbal", "numeric", 1.0, {"scale": 2000.0, "lower": 0.1, "upper": 1.0})]),
    f"with {_SUP} select a.s_suppkey id1, b.s_suppkey id2, round(case when d < 0.1 then 0 when d > 1 then 1 else d end, 9) distance from (select a, b, abs(a.s_acctbal - b.s_acctbal) / 2000 d {_PAIR})")
add("sim_categorical", lambda t: _sim(t, [Part("region", "categorical", 1.0, {"cardinality": 5}), Part("s_name", "categorical")]), f"with {_SUP} select a.s_suppkey id1, b.s_suppkey id2, 0.5::double distance {_PAIR}")
add("sim_mixed", lambda t: _sim(t, [Part("s_acctbal", "numeric", 3.0, {"scale": 10000.0}), Part("s_name", "text", 1.0, {"strategy": "charPair"})], threshold=0.3),
    f"""with {_SUP}, g as (select s_suppkey, s_nationkey, s_acctbal, list_distinct(list_transform(generate_series(1, length(s_name) - 1), lambda i: substr(s_name, i, 2))) q from s),
    d as (select a.s_suppkey id1, b.s_suppkey id2, (3 * abs(a.s_acctbal - b.s_acctbal) / 10000 + 1 - 2 * len(list_intersect(a.q, b.q)) / (len(a.q) + len(b.q))) / 4 distance from g a join g b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey)
    select id1, id2, round(distance, 9) distance from d where distance <= 0.3""")  # fmt: skip


def _names(t):
    return t.part.select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("words"))


_NM = "n as (select p_partkey, p_brand, list_filter(string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda w: w <> '') w from part), p as (select a.p_partkey id1, b.p_partkey id2, a.w x, b.w y, list_intersect(a.w, b.w) m from n a join n b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey)"
for _s, _q in (("jaccard", "1 - len(m) / len(list_distinct(list_concat(x, y)))"), ("dice", "1 - 2 * len(m) / (len(list_distinct(x)) + len(list_distinct(y)))")):
    add(f"sim_{_s}", lambda t, s=_s: _near(si.record_similarity(_names(t), "p_partkey", [Part("words", "text", 1.0, {"strategy": s})], block="p_brand"), 6), f"with {_NM} select id1, id2, round({_q}, 6) distance from p")
add("sim_cosine", lambda t: _near(si.record_similarity(_names(t), "p_partkey", [Part("words", "text", 1.0, {"strategy": "cosine"})], block="p_brand"), 6),
    f"with {_NM}, c as (select p_partkey, p_brand, u w, count(*) c from (select p_partkey, p_brand, unnest(w) u from n) group by all), l as (select p_partkey, p_brand, sqrt(sum(c * c)) l from c group by all), d as (select a.p_partkey i, b.p_partkey j, sum(a.c * b.c) s from c a join c b on a.w = b.w and a.p_brand = b.p_brand and a.p_partkey < b.p_partkey group by all) select a.p_partkey id1, b.p_partkey id2, round(1 - coalesce(s, 0) / (a.l * b.l), 6) distance from l a join l b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey left join d on i = a.p_partkey and j = b.p_partkey")
_vec = lambda t, kind: rounded(si.record_similarity(t.embeddings.where("label is not null"), "vec_id", [Part("embedding", "vector", 1.0, {"kind": kind})], block="label"), 4, "distance")
_VP = "from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id"
add("sim_vector_euclidean", lambda t: _vec(t, "euclidean"), f"select a.vec_id id1, b.vec_id id2, round(list_distance(a.embedding::double[], b.embedding::double[]), 4) distance {_VP}")
add("sim_vector_cosine", lambda t: _vec(t, "cosine"), f"select a.vec_id id1, b.vec_id id2, round(list_cosine_distance(a.embedding::double[], b.embedding::double[]), 4) distance {_VP}")
_pairs = lambda t: si.both_ways(si.record_similarity(_sup(t), "s_suppkey", [Part("s_acctbal", "numeric", 1.0, {"scale": 100.0})], block="s_nationkey"))
_TM = f"with {_SUP}, m as (select a.s_suppkey id1, b.s_suppkey id2, abs(a.s_acctbal - b.s_acctbal) / 100 distance from s a join s b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey), r as (select *, row_number() over (partition by id1 order by distance, id2) k from m where distance <= 20)"
add("top_matches", lambda t: rounded(si.top_matches(_pairs(t), "id1", "id2", "distance", n=3, max_dist=20), 6, "distance"), f"{_TM} select id1, id2, round(distance, 6) distance, cast(k as int) as rank from r where k <= 3")
add("top_matches_compact", lambda t: si.top_matches(_pairs(t), "id1", "id2", "distance", n=3, max_dist=20, compact=True), f"{_TM} select id1, list(id2 order by k) matches from r where k <= 3 group by 1")

_others = lambda t: t.customer.join(t.nation, t.customer.c_nationkey == t.nation.n_nationkey).select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"), F.col("n_regionkey").alias("region"))
_SQ = "abs(a.s_acctbal - b.c_acctbal) / 5000"
add("sim_two_sets", lambda t: rounded(si.record_similarity(_sup(t), "s_suppkey", [Part("s_acctbal", "numeric", 1.0, {"scale": 5000.0})], other=_others(t), block="s_nationkey", threshold=0.5), 6, "distance"),
    f"select s_suppkey id1, c_custkey id2, round({_SQ}, 6) distance from supplier a join customer b on s_nationkey = c_nationkey where {_SQ} <= 0.5")
# The distances of priorities, by how they share out over the states of orders, looked up in the comparison of customers' nations.
_VDM = {("1-URGENT", "2-HIGH"): 0.1, ("1-URGENT", "3-MEDIUM"): 0.4, ("5-LOW", "1-URGENT"): 0.9, ("2-HIGH", "3-MEDIUM"): 0.3}
_VT = " union all ".join(f"select '{min(k)}' u, '{max(k)}' w, {v} d" for k, v in _VDM.items())
_most = lambda t: t.supplier.select("s_suppkey", "s_nationkey", F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), F.pmod("s_suppkey", F.lit(5)).cast("int") + 1).alias("p"))
add("sim_value_difference", lambda t: si.record_similarity(_most(t), "s_suppkey", [Part("p", "valueDifference", 1.0, {"table": _VDM})], block="s_nationkey"),
    f"with v as ({_VT}), s as (select s_suppkey, s_nationkey, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][s_suppkey % 5 + 1] p from supplier) select a.s_suppkey id1, b.s_suppkey id2, case when a.p = b.p then 0 else coalesce(d, 1) end::double distance {_PAIR} left join v on u = least(a.p, b.p) and w = greatest(a.p, b.p)")
for _h, _q in (("euclidean", "sqrt(x * x + y * y) / 2"), ("manhattan", "(x + y) / 2"), ("minkowski", "pow((pow(x, 3) + pow(y, 3)) / 2, 1.0 / 3)"), ("categorical", "(x + y) / 2")):
    add(f"sim_aggregate_{_h}", lambda t, h=_h: rounded(si.record_similarity(_sup(t), "s_suppkey", [Part("s_acctbal", "numeric", 1.0, {"scale": 5000.0}), Part("s_suppkey", "numeric", 1.0, {"scale": 500.0})], block="s_nationkey", how=h), 6, "distance"),
        f"with {_SUP}, d as (select a.s_suppkey id1, b.s_suppkey id2, abs(a.s_acctbal - b.s_acctbal) / 5000 x, abs(a.s_suppkey - b.s_suppkey) / 500 y {_PAIR}) select id1, id2, round({_q}, 6) distance from d")
add("sim_within_key_self", lambda t: _sim(t, [Part("s_acctbal", "numeric", 1.0, {"scale": 2000.0})], include_self=True, scale=1000.0).withColumn("distance", F.col("distance").cast("long")),
    f"with {_SUP} select a.s_suppkey id1, b.s_suppkey id2, cast(floor(abs(a.s_acctbal - b.s_acctbal) / 2000 * 1000 + 0.5) as bigint) distance {_PAIR.replace('a.s_suppkey < b', 'a.s_suppkey <= b')}")
add("sim_vector_manhattan", lambda t: _vec(t, "manhattan"), f"select a.vec_id id1, b.vec_id id2, round(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: abs(p[1] - p[2]))), 4) distance {_VP}")
add("hist_text", lambda t: hi.to_text(hi.from_text(hi.to_text(_hist(t), ["l_returnflag"]), ["l_returnflag"]), ["l_returnflag"]), f"with {_H} select l_returnflag, string_agg(bin || ':' || count, ',' order by bin) as text from h group by 1")
add("season_first_cycle", lambda t: t.events.select("event_id", *[c.alias(n) for c, n in zip(first_cycle(_seconds(t.events), [{"cycle": "weekEndDayOfWeek"}, {"cycle": "hourRangeOfDay", "groups": [(6, 11), (18, 20)]}]), ("kind", "cycle_index"), strict=True)]),
    """with e as (select event_id, (epoch_us(ts) // 1000000 % 604800) // 86400 d, hour(ts) h from events) select event_id, case when d > 4 then 'weekEndDayOfWeek' when h between 6 and 11 or h between 18 and 20 then 'hourRangeOfDay' else 'normal' end kind,
    cast(case when d > 4 then d when h between 6 and 11 then 0 when h between 18 and 20 then 1 else 0 end as bigint) cycle_index from e""")  # fmt: skip

# JSON and text extraction

_docs = lambda t: t.orders.join(t.lineitem, t.orders.o_orderkey == t.lineitem.l_orderkey).groupBy("o_orderkey", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags")))).alias("lines")).select("o_orderkey", F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("head"), "lines")).alias("doc"))
_SCHEMA = "head struct<status:string>, lines array<struct<n:int,part:bigint,flags:array<string>>>"
add("json_flat", lambda t: ex.extract_flat(t.events, "props", {"k": "$.k", "none": "$.a.b"}, ["event_id"], default="-"), "select event_id, coalesce(json_extract_string(props, '$.k'), '-') k, '-' as none from events")
add("json_explode", lambda t: ex.extract_denormalized(ex.parse_json(_docs(t), "doc", _SCHEMA), "json", ["lines", "lines[].flags"], {"status": "head.status", "line": "lines[].n", "flag": "lines[].flags[]."}, ["o_orderkey"]),
    "select o_orderkey, o_orderstatus status, cast(l_linenumber as varchar) line, unnest([l_returnflag, l_linestatus]) flag from orders join lineitem on l_orderkey = o_orderkey")
add("json_parent_child", lambda t: ex.extract_normalized(ex.parse_json(_docs(t), "doc", _SCHEMA), "json", "o_orderkey", {"status": "head.status"}, {"line": ("lines", {"n": "n", "part": "part"})}).children["line"],
    "select o_orderkey, cast(row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 as int) pos, cast(l_linenumber as varchar) n, cast(l_partkey as varchar) part from orders join lineitem on l_orderkey = o_orderkey")
add("json_root", lambda t: ex.extract_normalized(ex.parse_json(_docs(t), "doc", _SCHEMA), "json", "o_orderkey", {"status": "head.status"}, {}).root, "select o_orderkey, o_orderstatus status from orders where o_orderkey in (select l_orderkey from lineitem)")
add("regex_extract", lambda t: ex.extract_regex(t.documents.where("file_path is not null"), "file_path", r"(.*)/([^/]+)\.(\w+)", ["folder", "stem", "extension"], ["doc_id"]),
    "select doc_id, regexp_extract(file_path, '^(.*)/([^/]+)\\.(\\w+)$', 1) folder, regexp_extract(file_path, '^(.*)/([^/]+)\\.(\\w+)$', 2) stem, regexp_extract(file_path, '^(.*)/([^/]+)\\.(\\w+)$', 3) extension from documents where regexp_full_match(file_path, '(.*)/([^/]+)\\.(\\w+)')")
add("raw_extract", lambda t: ex.extract_raw(t.part, "p_brand", {"number": ("regex", r"#(\d+)"), "head": ("substring", (0, 5)), "all": ("verbatim", None)}, ["p_partkey"]),
    """select p_partkey, regexp_extract(p_brand, '#(\\d+)', 1) number, substr(p_brand, 1, 5) head, p_brand as "all" from part""")  # fmt: skip
add("multiline_flatten", lambda t: ex.flatten_multiline(t.retail_order_lines, "line_text", "line_no", r"^\d{4}-", ["file_name"]),
    "with l as (select *, sum(regexp_matches(line_text, '^\\d{4}-')::int) over (partition by file_name order by line_no) record from retail_order_lines where line_text is not null) select file_name, cast(record as bigint) record, string_agg(line_text, ' ' order by line_no) line_text from l where record > 0 group by all")

QUERIES, SQL = registry.queries, registry.sql
