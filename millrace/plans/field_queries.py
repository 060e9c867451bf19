"""Queries of field transformers, validators, distances, samplers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import sampling
from millrace.functions import transform as tr
from millrace.functions import validators as va
from millrace.functions.transform import Spec, transform
from millrace.operators import stats as st
from millrace.operators.common import scratch
from millrace.plans.registry import Registry
from millrace.sources import streams, text
from millrace.sources.tables import read
from millrace.streaming import aggregate as stream

registry = Registry()
add = registry.add


def tr1(name, table, key, column, chain, sql, outputs=("out",)):
    """A chain on one column: key and outputs."""
    add(f"tr_{name}", lambda t: transform(getattr(t, table).select(key, F.col(column).alias("x")) if key != column else getattr(t, table).select(key, F.col(column).alias("x")), [Spec("x", chain, outputs)], keep_rest=True), f"select {key}, {sql} from {table}")


# Text

tr1("lower", "customer", "c_custkey", "c_mktsegment", [("lowerCaseTrans", {})], "lower(c_mktsegment) as out")
tr1("upper", "part", "p_partkey", "p_type", [("upperCaseTrans", {})], "upper(p_type) as out")
tr1("upper_first", "part", "p_partkey", "p_name", [("upperCaseFirstTrans", {})], "upper(substr(p_name, 1, 1)) as out")
tr1("upper_first_keep", "part", "p_partkey", "p_name", [("upperCaseFirstTrans", {"keep_rest": True})], "upper(substr(p_name, 1, 1)) || substr(p_name, 2) as out")
tr1("trim", "usage_records", "usage_id", "device_id", [("trimTrans", {})], "trim(device_id) as out")
tr1("pattern", "customer", "c_custkey", "c_name", [("patternBasedTrans", {"pattern": r"(\w+)#0*(\d+)", "n": 2, "keep": True})], "c_name as a, regexp_extract(c_name, '^(\\w+)#0*(\\d+)$', 1) b, regexp_extract(c_name, '^(\\w+)#0*(\\d+)$', 2) c", ("a", "b", "c"))
tr1("search_replace", "part", "p_partkey", "p_name", [("searchReplaceTrans", {"search": "[aeiou]", "replace": "_"})], "regexp_replace(p_name, '[aeiou]', '_', 'g') as out")
tr1("search_replace_first", "part", "p_partkey", "p_name", [("searchReplaceTrans", {"search": "[aeiou]", "replace": "_", "first_only": True})], "regexp_replace(p_name, '[aeiou]', '_') as out")
tr1("pattern_mask", "customer", "c_custkey", "c_name", [("patternBasedSearchReplaceTrans", {"patterns": [r"Client#(\d+)", r"#(\d{6})"], "mask": "x"})], "replace(c_name, regexp_extract(c_name, '#(\\d{6})', 1), 'xxxxxx') as out")
tr1("key_value", "orders", "o_orderkey", "o_orderstatus", [("keyValueTrans", {"mapping": {"F": "filled", "O": "open"}})], "case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else o_orderstatus end as out")
tr1("key_value_keep", "orders", "o_orderkey", "o_orderstatus", [("keyValueTrans", {"mapping": {"F": "filled"}, "keep": True})], "o_orderstatus a, case o_orderstatus when 'F' then 'filled' else o_orderstatus end b", ("a", "b"))
tr1("default_value", "documents", "doc_id", "lang", [("defaultValueTrans", {"default": "none"})], "case when lang is null or lang = '' then 'none' else lang end as out")
tr1("forced_replace", "orders", "o_orderkey", "o_orderstatus", [("forcedReplaceTrans", {"value": "-"})], "'-' as out")
tr1("anonymize", "part", "p_partkey", "p_name", [("anoynmizerTrans", {"mask": "#"})], "repeat('#', length(p_name)) as out")
tr1("group", "region", "r_regionkey", "r_name", [("groupTrans", {"groups": {"new": ["AMERICA"], "old": ["AFRICA", "ASIA", "EUROPE", "MIDDLE EAST"]}})], "r_name a, case when r_name = 'AMERICA' then 'new' else 'old' end b", ("a", "b"))
tr1("custom_text", "part", "p_partkey", "p_name", [("stringCustomTrans", {"script": "concat(reverse(x), :end)", "params": {"end": "!"}})], "reverse(p_name) || '!' as out")
tr1("custom_long", "part", "p_partkey", "p_size", [("longCustomTrans", {"script": "x * x + :k", "params": {"k": 3}})], "p_size * p_size + 3 as out")
tr1("custom_double", "lineitem", "l_orderkey", "l_tax", [("doubleCustomTrans", {"script": "round(x * 1.5D, 6)"})], "round(l_tax * 1.5, 6) as out")
tr1("delete", "part", "p_partkey", "p_name", [("stringDeleteTrans", {})], "1 as one", ())
registry.sql["tr_delete"] = "select p_partkey from part"
tr1("concatenate", "part", "p_partkey", "p_name", [("stringConcatenationTrans", {"text": "part", "delim": ": ", "prepend": True})], "'part: ' || p_name as out")
add("tr_field_merge", lambda t: transform(t.part, [Spec("p_partkey"), Spec("p_name", [("stringFieldMergeTrans", {"fields": ["p_brand", "p_type"], "delim": "|"})], ["out"])]), "select p_partkey, p_name || '|' || p_brand || '|' || p_type as out from part")
tr1("split_first", "part", "p_partkey", "p_name", [("stringSplitTrans", {"delim": " "})], "split_part(p_name, ' ', 1) a, case when contains(p_name, ' ') then substr(p_name, instr(p_name, ' ') + 1) else '' end b", ("a", "b"))
tr1("split_last", "customer", "c_custkey", "c_name", [("stringSplitTrans", {"delim": "0", "at": "last", "keep": "both"})], "regexp_extract(c_name, '^(.*)0([^0]*)$', 1) a, regexp_extract(c_name, '^(.*)0([^0]*)$', 2) b", ("a", "b"))
tr1("split_all", "part", "p_partkey", "p_name", [("stringSplitTrans", {"delim": " ", "at": "all"})], "string_split(p_name, ' ') as out")
tr1("string_binary", "orders", "o_orderkey", "o_orderstatus", [("stringBinaryTrans", {"value": "F", "true": "yes", "false": "no"})], "case when o_orderstatus = 'F' then 'yes' else 'no' end as out")
tr1("one_hot", "orders", "o_orderkey", "o_orderstatus", [("categoricalBinaryTrans", {"cardinality": ["F", "O", "P"]})], "(o_orderstatus = 'F')::int a, (o_orderstatus = 'O')::int b, (o_orderstatus = 'P')::int c", ("a", "b", "c"))
add("tr_within_field_delim", lambda t: transform(t.part.select("p_partkey", F.expr("concat_ws(',', p_brand, case when p_size > 25 then replace(p_name, ' ', ',') else p_name end, p_type)").alias("x")), [Spec("x", [("stringWithinFieldDelimTrans", {"start": 1, "n": 2, "width": 3})], ["a", "b", "c"])], keep_rest=True),
    "select p_partkey, p_brand a, p_name b, p_type c from part")
add("tr_chain", lambda t: transform(t.customer, [Spec("c_custkey"), Spec("c_name", [("lowerCaseTrans", {}), ("searchReplaceTrans", {"search": "#0+", "replace": "-"}), ("stringSplitTrans", {"delim": "-"})], ["kind", "number"])]),
    "select c_custkey, split_part(regexp_replace(lower(c_name), '#0+', '-'), '-', 1) kind, case when contains(regexp_replace(lower(c_name), '#0+', '-'), '-') then split_part(regexp_replace(lower(c_name), '#0+', '-'), '-', 2) else '' end number from customer")
add("tr_clean_tokens", lambda t: t.part.select("p_partkey", tr.clean_tokens(F.col("p_name"), stop_words=["ring"]).alias("out")), "select p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '' and w <> 'ring') as out from part")
add("tr_include_exclude", lambda t: t.customer.select("c_custkey", tr.include_exclude(F.col("c_name"), include="[A-Za-z]+|[1-9]", exclude="u").alias("out")), "select c_custkey, replace(array_to_string(regexp_extract_all(c_name, '[A-Za-z]+|[1-9]'), ' '), 'u', '') as out from customer")
add("tr_helpers", lambda t: t.part.select("p_partkey", tr.nth_part(F.col("p_name"), " ", 1).alias("second"), tr.digest(F.col("p_name")).alias("m"), tr.digest(F.col("p_name"), "sha256").alias("s"), F.array_except(F.split("p_name", " "), F.array(F.lit("ring"))).alias("less")),
    "select p_partkey, string_split(p_name, ' ')[2] as second, md5(p_name) m, sha256(p_name) s, list_filter(string_split(p_name, ' '), lambda w: w <> 'ring') less from part")

# Numbers

tr1("long_polynomial", "part", "p_partkey", "p_size", [("longPolynomialTrans", {"a": 2, "b": -3, "k": 5})], "cast(p_size * p_size * 2 - p_size * 3 + 5 as bigint) as out")
tr1("double_polynomial", "part", "p_partkey", "p_retailprice", [("doublePolynomialTrans", {"a": 0.5, "b": 2, "k": 1}), ("floatRoundOffTrans", {"precision": 3})], "round(p_retailprice * p_retailprice * 0.5 + p_retailprice * 2 + 1, 3) as out")
tr1("discretize", "customer", "c_custkey", "c_acctbal", [("discretizerTrans", {"width": 700})], "cast(trunc(c_acctbal / 700) as int) as out")
tr1("binary", "customer", "c_custkey", "c_acctbal", [("binaryTrans", {"threshold": 1000, "upper": 9, "lower": 3})], "case when c_acctbal >= 1000 then 9 else 3 end as out")
for _op, _sym in (("Add", "+"), ("Subtract", "-"), ("Multiply", "*"), ("Divide", "//")):
    tr1(f"int_{_op.lower()}", "part", "p_partkey", "p_size", [(f"int{_op}Trans", {"const": 7})], f"cast(p_size {_sym} 7 as bigint) as out")
    tr1(f"double_{_op.lower()}", "part", "p_partkey", "p_retailprice", [(f"double{_op}Trans", {"const": 2.5}), ("floatRoundOffTrans", {"precision": 6})], f"round(p_retailprice {_sym[0]} 2.5, 6) as out")
add("tr_two_fields", lambda t: transform(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), [Spec("l_orderkey"), Spec("l_linenumber"), Spec("l_partkey"), Spec(None, [("binaryArithOperatorGen", {"left": "l_extendedprice", "right": "l_quantity", "op": "/", "out": "long"})], ["unit"])]),
    "select l_orderkey, l_linenumber, l_partkey, cast(floor(l_extendedprice / l_quantity + 0.5) as bigint) unit from lineitem")
tr1("field_and_constant", "part", "p_partkey", "p_retailprice", [("binaryConstOperatorTrans", {"const": 3, "op": "/", "out": "int"})], "cast(floor(p_retailprice / 3 + 0.5) as int) as out")
tr1("int_round", "customer", "c_custkey", "c_acctbal", [("intRoundOffTrans", {})], "cast(floor(c_acctbal + 0.5) as bigint) as out")
tr1("float_round", "part", "p_partkey", "p_retailprice", [("doubleDivideTrans", {"const": 7}), ("floatRoundOffTrans", {"precision": 2})], "round(p_retailprice / 7, 2) as out")
for _f, _q in (("log", "ln(p_retailprice)"), ("logTen", "log10(p_retailprice)"), ("sqRoot", "sqrt(p_retailprice)"), ("power", "pow(p_retailprice, 2)"), ("exp", "exp(p_retailprice / 1000)"), ("sigmoid", "1 / (1 + exp(-p_retailprice / 1000))")):
    _pre = [("doubleDivideTrans", {"const": 1000})] if _f in ("exp", "sigmoid") else []
    tr1(f"math_{_f}", "part", "p_partkey", "p_retailprice", [*_pre, ("mathFunction", {"function": _f}), ("floatRoundOffTrans", {"precision": 5})], f"round({_q}, 5) as out")
add("tr_scaling", lambda t: t.part.select("p_partkey", F.round(tr.logistic_scale(F.col("p_size"), 25.0, 0.2), 6).alias("a"), F.round(tr.exponential_scale(F.col("p_size"), 0.05), 6).alias("b"), F.round(tr.piecewise(F.col("p_size"), [(5, 0), (20, 10), (40, 12)]), 6).alias("c")),
    "select p_partkey, round(1 / (1 + exp(-0.2 * (p_size - 25))), 6) a, round(1 - exp(-0.05 * p_size), 6) b, round(case when p_size <= 5 then 0 when p_size < 20 then (p_size - 5) * 10 / 15 when p_size < 40 then 10 + (p_size - 20) * 0.1 else 12 end, 6) c from part")
add("geo_distance", lambda t: t.customer.select("c_custkey", F.round(tr.haversine_km(F.col("c_custkey") % 80, F.col("c_custkey") % 170, F.lit(48.0), F.lit(2.0)), 3).alias("km")),
    "select c_custkey, round(2 * 6371 * asin(sqrt(least(pow(sin((radians(48.0) - radians(c_custkey % 80)) / 2), 2) + cos(radians(c_custkey % 80)) * cos(radians(48.0)) * pow(sin(radians(2.0 - c_custkey % 170) / 2), 2), 1.0))), 3) km from customer")

# Dates

_o = lambda t: t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("x"), F.col("o_orderdate").alias("d"), "o_custkey")
add("tr_date_format", lambda t: transform(_o(t), [Spec("o_orderkey"), Spec("x", [("dateFormatTrans", {"source": "yyyy-MM-dd HH:mm", "target": "dd/MM/yyyy HH:mm", "target_zone": "Asia/Kolkata"})], ["a"]), Spec("x", [("dateFormatTrans", {"source": "yyyy-MM-dd HH:mm", "target": "epochMs", "source_zone": "Asia/Kolkata"})], ["b"])]),
    "select o_orderkey, strftime(o_orderdate + interval 330 minute, '%d/%m/%Y %H:%M') a, cast(epoch_ms(o_orderdate) - 19800000 as bigint) b from orders")
add("tr_date_from_epoch", lambda t: transform(t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("x")), [Spec("event_id"), Spec("x", [("dateFormatTrans", {"target": "yyyy-MM-dd HH:mm:ss"})], ["out"])]), "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as out from events")
add("tr_elapsed", lambda t: transform(_o(t), [Spec("o_orderkey"), Spec("x", [("elapsedTimeTrans", {"unit": "day", "format": "yyyy-MM-dd HH:mm", "reference": "1996-01-01 12:00", "behind": "zero"})], ["out"])]),
    "select o_orderkey, cast(case when o_orderdate >= '1996-01-01 12:00' then floor((epoch_ms(o_orderdate) - epoch_ms(timestamp '1996-01-01 12:00')) / 86400000 + 0.5) else 0 end as bigint) as out from orders")
add("tr_elapsed_contextual", lambda t: transform(t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("x"), F.expr("date_format(o_orderdate - make_interval(0, 0, 0, cast(o_custkey % 50 as int)), 'yyyy-MM-dd')").alias("ref")), [Spec("o_orderkey"), Spec("x", [("contextualElapsedTimeTrans", {"unit": "week", "format": "yyyy-MM-dd", "reference_field": "ref"})], ["out"])]),
    "select o_orderkey, cast(floor((o_custkey % 50) / 7 + 0.5) as bigint) as out from orders")


def _shift(step: str, d: str = "cast(o_orderdate as date)", ref: str = "date '2003-02-28'") -> str:
    """The least shift by whole steps of months that is not before the reference."""
    n = f"greatest(((year({ref}) - year({d})) * 12 + month({ref}) - month({d})) // {step}, 0)"
    return f"cast(case when {d} >= {ref} then {d} when {d} + to_months(cast({n} * {step} as int)) >= {ref} then {d} + to_months(cast({n} * {step} as int)) else {d} + to_months(cast(({n} + 1) * {step} as int)) end as date)"


add("tr_cycle_shift", lambda t: transform(_o(t), [Spec("o_orderkey"), *[Spec("d", [("timeCycleShiftTrans", {"unit": u, "reference": "2003-02-28"})], [u]) for u in ("month", "quarter", "semiAnnual", "year")]]),
    f'select o_orderkey, {_shift("1")} as "month", {_shift("3")} as "quarter", {_shift("6")} "semiAnnual", {_shift("12")} as "year" from orders')
add("tr_cycle_shift_contextual", lambda t: transform(t.orders.select("o_orderkey", F.col("o_orderdate").alias("d"), F.expr("case when o_custkey % 2 = 0 then 'month' else 'year' end").alias("u"), F.lit("2003-02-28").alias("ref")), [Spec("o_orderkey"), Spec("d", [("contextualTimeCycleShiftTrans", {"unit_field": "u", "reference_field": "ref"})], ["out"])]),
    f"select o_orderkey, case when o_custkey % 2 = 0 then {_shift('1')} else {_shift('12')} end as out from orders")
add("tr_date_components", lambda t: transform(_o(t), [Spec("o_orderkey"), Spec("d", [("dateComponentTrans", {"components": ["year", "quarter", "dayOfWeek", "MM-dd"]})], ["y", "q", "w", "md"])]),
    "select o_orderkey, cast(year(o_orderdate) as int) y, cast(quarter(o_orderdate) as int) q, cast(dayofweek(o_orderdate) + 1 as int) w, strftime(o_orderdate, '%m-%d') md from orders")
add("tr_time_cycle", lambda t: transform(t.events, [Spec("event_id"), Spec("ts", [("timeCycleTrans", {"cycles": "hourOfDay", "hour_granularity": 3})], ["out"])]), "select event_id, cast(hour(ts) // 3 as int) as out from events")
add("tr_multi_time_cycle", lambda t: transform(t.events, [Spec("event_id"), Spec("ts", [("multiTimeCycleTrans", {"cycles": ["hourOfDay", "dayOfWeek", "dayOfMonth", "monthOfYear", "quarterOfYear"]})], ["a", "b", "c", "d", "e"])]),
    "select event_id, cast(hour(ts) as int) a, cast(dayofweek(ts) + 1 as int) b, cast(day(ts) as int) c, cast(month(ts) as int) d, cast(quarter(ts) as int) e from events")
add("tr_constant", lambda t: transform(t.region, [Spec("r_regionkey"), Spec(None, [("constGen", {"value": "x"})], ["out"])]), "select r_regionkey, 'x' as out from region")
add("tr_unique_key", lambda t: transform(t.events, [Spec("event_id"), Spec(None, [("uniqueKeyGen", {})], ["out"])]))
add("tr_epoch_now", lambda t: transform(t.events, [Spec("event_id"), Spec(None, [("epochTimeGen", {})], ["out"])]))
add("tr_date_gen", lambda t: transform(t.events, [Spec("event_id"), Spec(None, [("dateGen", {"format": "yyyy"})], ["out"])]))

# Validators


def val(name, table, key, column, tag, options, sql):
    add(f"val_{name}", lambda t: getattr(t, table).select(key, va.VALIDATORS[tag](F.col(column), **options).alias("ok")), f"select {key}, coalesce({sql}, false) ok from {table}")


val("min_int", "part", "p_partkey", "p_size", "minInt", {"value": 10}, "p_size >= 10")
val("max_int", "part", "p_partkey", "p_size", "maxInt", {"value": 10}, "p_size <= 10")
val("min_double", "customer", "c_custkey", "c_acctbal", "minDouble", {"value": 0.5}, "c_acctbal >= 0.5")
val("max_double", "customer", "c_custkey", "c_acctbal", "maxDouble", {"value": 5000.0}, "c_acctbal <= 5000")
val("min_string", "customer", "c_custkey", "c_mktsegment", "minString", {"value": "F"}, "c_mktsegment >= 'F'")
val("max_string", "customer", "c_custkey", "c_mktsegment", "maxString", {"value": "H"}, "c_mktsegment <= 'H'")
val("min_date", "orders", "o_orderkey", "o_orderdate", "minDate", {"value": "1997-05-01"}, "o_orderdate > '1997-05-01'")
val("min_length", "part", "p_partkey", "p_name", "minLength", {"value": 9}, "length(p_name) >= 9")
val("max_length", "part", "p_partkey", "p_name", "maxLength", {"value": 9}, "length(p_name) <= 9")
val("exact_length", "part", "p_partkey", "p_name", "exactLength", {"value": 9}, "length(p_name) = 9")
val("not_missing", "documents", "doc_id", "lang", "notMissing", {"tag": "python"}, "lang is not null and lang <> '' and lang <> 'python'")
val("pattern", "part", "p_partkey", "p_brand", "pattern", {"value": r"Brand#\d"}, "regexp_full_match(p_brand, 'Brand#\\d')")
_MADE = {
    "name": "concat(initcap(split(p_name, ' ')[0]), if(p_size % 3 = 0, '  ', ' '), initcap(p_type))", "SSN": "concat(lpad(p_partkey % 1000, 3, '0'), if(p_size % 2 = 0, '-', '.'), lpad(p_size, 2, '0'), '-', lpad(p_partkey % 10000, 4, '7'))",
    "phoneNumber": "concat('(', lpad(p_partkey % 1000, if(p_size % 5 = 0, 2, 3), '0'), ') 555-', lpad(p_size, 4, '0'))", "streetAddress": "concat(if(p_size % 4 = 0, 'x', cast(p_size as string)), ' ', p_name, ' Street')", "city": "concat(p_name, if(p_size % 4 = 0, ' 9', ''))",
    "zip": "concat(lpad(p_partkey % 100000, if(p_size % 4 = 0, 4, 5), '0'), if(p_size % 3 = 0, '-1234', ''))", "id": "concat(p_partkey, if(p_size % 4 = 0, '_', '-'), p_type)", "state": "substr('ny CAtxXXwa', 1 + p_size % 10, 2)",
    "currency": "substr('USDeurDKKJPY', 1 + 3 * (p_size % 4) + if(p_size % 5 = 0, 1, 0), 3)", "boolean": "substr('YESnotrueF', 1 + p_size % 8, 1 + p_size % 3)",
}
for _p, _e in _MADE.items():
    _duck = _e.replace("split(p_name, ' ')[0]", "string_split(p_name, ' ')[1]").replace("initcap(string_split(p_name, ' ')[1])", "upper(substr(string_split(p_name, ' ')[1], 1, 1)) || substr(string_split(p_name, ' ')[1], 2)").replace("initcap(p_type)", "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))")
    for _n in ("p_partkey % 1000,", "p_partkey % 10000,", "p_partkey % 100000,", "p_size,"):
        _duck = _duck.replace(f"lpad({_n}", f"lpad(cast({_n[:-1]} as varchar),")
    add(f"val_predefined_{_p}", lambda t, e=_e, n=_p: t.part.select("p_partkey", F.expr(e).alias("x")).select("p_partkey", va.named_pattern(F.col("x"), n).alias("ok")),
        f"select p_partkey, regexp_full_match({f'upper({_duck})' if _p in va.UPPER_CASED else _duck}, '{va.PATTERNS[_p].strip('^$')}') ok from part")
_L = "split(line_text, ',')"
add("val_ensure_date", lambda t: t.retail_order_lines.select("raw_id", va.ensure_date(F.expr(f"{_L}[0]"), "yyyy-MM-dd").alias("ok")),
    "select raw_id, coalesce(regexp_full_match(string_split(line_text, ',')[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(string_split(line_text, ',')[1] as date) is not null, false) ok from retail_order_lines")
add("val_ensure_int", lambda t: t.retail_order_lines.select("raw_id", va.VALIDATORS["ensureInt"](F.expr(f"get({_L}, 6)")).alias("ok")),
    "select raw_id, coalesce(regexp_full_match(string_split(line_text, ',')[7], '\\s*[+-]?\\d+\\s*') and try_cast(trim(string_split(line_text, ',')[7]) as int) is not null, false) ok from retail_order_lines")
add("val_ensure_long", lambda t: t.retail_order_lines.select("raw_id", va.VALIDATORS["ensureLong"](F.expr(f"get({_L}, 6)")).alias("ok")),
    "select raw_id, coalesce(regexp_full_match(string_split(line_text, ',')[7], '\\s*[+-]?\\d+\\s*') and try_cast(trim(string_split(line_text, ',')[7]) as bigint) is not null, false) ok from retail_order_lines")
add("val_ensure_double", lambda t: t.retail_order_lines.select("raw_id", va.VALIDATORS["ensureDouble"](F.expr(f"get({_L}, 7)")).alias("ok")), "select raw_id, try_cast(trim(string_split(line_text, ',')[8]) as double) is not null ok from retail_order_lines")
add("val_max_date", lambda t: t.retail_order_lines.select("raw_id", va.VALIDATORS["maxDate"](F.expr(f"{_L}[0]"), "2024-02-01", format="yyyy-MM-dd").alias("ok")),
    "select raw_id, coalesce(regexp_full_match(string_split(line_text, ',')[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(string_split(line_text, ',')[1] as date) < date '2024-02-01', false) ok from retail_order_lines")
val("membership", "orders", "o_orderkey", "o_orderstatus", "membership", {"value": ["F", "P"]}, "o_orderstatus in ('F', 'P')")
val("zscore", "customer", "c_custkey", "c_acctbal", "zscoreBasedRange", {"mean": 4500.0, "std_dev": 3000.0, "max_z": 1.2}, "abs(c_acctbal - 4500) <= 3000 * 1.2")
val("robust_zscore", "customer", "c_custkey", "c_acctbal", "robustZscoreBasedRange", {"median": 4500.0, "deviation": 2500.0, "max_z": 1.5}, "abs(c_acctbal - 4500) <= 2500 * 1.5")
add("val_membership_ext", lambda t: va.external_membership(t.retail_orders.select("order_id", "product_id"), "product_id", t.product_max.withColumnRenamed("product_id", "pid"), "pid"), "select order_id, product_id, coalesce(product_id in (select product_id from product_max), false) known from retail_orders")


def _robust_keyed(t):
    med = st.median_stats(t.events, ["value"], ["event_type"]).select("event_type", "median")
    mad = st.median_stats(t.events, ["value"], ["event_type"], mad=True).select("event_type", "mad")
    return t.events.join(med, "event_type").join(mad, "event_type").select("event_id", va.holds(F.abs(F.col("value") - F.col("median")) <= 2.5 * F.col("mad")).alias("ok"))


add("val_robust_zscore_keyed", _robust_keyed,
    "with m as (select event_type, median(value) m from events group by 1), d as (select event_type, median(abs(value - m)) * 1.4296 d from events join m using (event_type) group by 1) select event_id, coalesce(abs(value - m) <= 2.5 * d, false) ok from events join m using (event_type) join d using (event_type)")
add("val_not_missing_group", lambda t: t.documents.select("doc_id", va.not_missing_group([["lang", "licence_file"], ["source"]]).alias("ok")), "select doc_id, (coalesce(lang, '') <> '' or coalesce(licence_file, '') <> '') and coalesce(source, '') <> '' ok from documents")
add("val_value_dependency", lambda t: t.documents.select("doc_id", va.value_dependency("source", "lang", {"openforge": "*", "oldtapes": "", "snipbin": ["python", "json"]}).alias("ok")),
    "select doc_id, case source when 'openforge' then coalesce(lang, '') <> '' when 'oldtapes' then coalesce(lang, '') = '' when 'snipbin' then coalesce(lang in ('python', 'json'), false) else true end ok from documents")
_CHECKS = [va.Check("c_acctbal", "minDouble", {"value": 0.0}), va.Check("c_acctbal", "maxDouble", {"value": 9000.0}), va.Check("c_mktsegment", "membership", {"value": ["BUILDING", "MACHINERY", "FURNITURE"]})]
_ROWS = lambda: {"key": F.col("c_custkey") % 11 > 0}
_TAGS = "list_filter([case when not c_acctbal >= 0 then 'minDouble' end, case when not c_acctbal <= 9000 then 'maxDouble' end], lambda x: x is not null)", "list_filter([case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'membership' end], lambda x: x is not null)", "list_filter([case when c_custkey % 11 = 0 then 'key' end], lambda x: x is not null)"
_OKROW = "(c_acctbal between 0 and 9000 and c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') and c_custkey % 11 > 0)"
add("val_tagged", lambda t: va.tag_rows(t.customer, _CHECKS, _ROWS()).select("c_custkey", "c_acctbal_failed", "c_mktsegment_failed", "row_failed", "valid"), f"select c_custkey, {_TAGS[0]} c_acctbal_failed, {_TAGS[1]} c_mktsegment_failed, {_TAGS[2]} row_failed, {_OKROW} as valid from customer")
add("val_split", lambda t: va.validate(t.customer, _CHECKS, _ROWS()).valid, f"select * from customer where {_OKROW}")
add("val_split_masked", lambda t: va.validate(t.customer, _CHECKS, _ROWS(), mask="?").invalid.select("c_custkey", "c_mktsegment"), f"select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') then c_mktsegment else '?' end c_mktsegment from customer where not {_OKROW}")
add("val_metric", lambda t: va.validity_metric(va.tag_rows(t.customer, _CHECKS), {"c_acctbal": 3, "c_mktsegment": 1}).select("c_custkey", "valid_fields", "validity"),
    "select c_custkey, (c_acctbal between 0 and 9000)::int + (c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE'))::int valid_fields, (3 * (c_acctbal between 0 and 9000)::int + (c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE'))::int) / 4 validity from customer")
_parts = lambda t: t.retail_order_lines.select("raw_id", F.get(F.split("line_text", ","), F.lit(6)).alias("quantity"), F.get(F.split("line_text", ","), F.lit(0)).alias("day"))
add("val_simple", lambda t: va.simple_validate(_parts(t), {"quantity": "int", "day": "date"}, "yyyy-MM-dd").valid,
    "with p as (select raw_id, string_split(line_text, ',')[7] quantity, string_split(line_text, ',')[1] as day from retail_order_lines) select * from p where regexp_full_match(quantity, '\\s*[+-]?\\d+\\s*') and try_cast(trim(quantity) as int) is not null and regexp_full_match(day, '\\d{4}-\\d{2}-\\d{2}') and try_cast(day as date) is not null")
add("val_simple_missing", lambda t: va.simple_validate(_parts(t), {"quantity": "int"}, missing_only=True).invalid.select("raw_id"), "select raw_id from retail_order_lines where coalesce(string_split(line_text, ',')[7], '') = ''")
add("val_outlier", lambda t: va.outlier_validate(t.events, st.numerical_stats(t.events, ["value"], ["user_id"]), ["user_id"], ["value"], chebyshev_p=0.3).select("event_id"),
    "select event_id from events join (select user_id, avg(value) m, stddev_pop(value) s, count(value) n from events group by 1) using (user_id) where n >= 2 and abs(value - m) > sqrt(1 / 0.3) * s")
add("val_custom_python", lambda t: va.tag_rows(t.part, [va.Check("p_name", "twoWords", {})], custom={"twoWords": lambda c, **_: F.size(F.split(c, " ")) == 2}).select("p_partkey", "valid"), "select p_partkey, len(string_split(p_name, ' ')) = 2 as valid from part")

#: An outside program that judges a line per row.
_JUDGE = "import sys\nfor s in sys.stdin:\n    b, m = s.rstrip(chr(10)).split(',')\n    print('true' if float(b) >= 0 and m != 'BUILDING' else 'false')"
add("val_piped", lambda t: va.piped(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal", "c_mktsegment"], ["python3", "-c", _JUDGE]), "select c_custkey, c_acctbal, c_mktsegment, c_acctbal >= 0 and c_mktsegment <> 'BUILDING' as valid from customer")

# Delimited text, written and read back


def text_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """A table through delimited text, a directory per entity."""
    path = scratch(spark, "text")
    text.write_delimited(read(spark, directory, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"), path, precision=1, partition_by=["c_nationkey"])
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])
    return text.read_delimited(spark, path, schema)


def text_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of text cut to named fields."""
    path = scratch(spark, "lines")
    text.write_delimited(read(spark, directory, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, sep=";")
    return text.split_lines(text.read_lines(spark, path), "value", ["key", "name", "region"], ";")


for _f in (text_round_trip, text_lines):
    registry.queries[_f.__name__] = _f
registry.sql["text_round_trip"] = "select c_custkey, c_name, round(c_acctbal, 1) c_acctbal, c_mktsegment, c_nationkey from customer"
registry.sql["text_lines"] = "select cast(n_nationkey as varchar) as key, n_name as name, cast(n_regionkey as varchar) region from nation"

# Samplers (no SQL: random)

add("sample_distributions", lambda t: t.customer.select("c_custkey", sampling.uniform(0, 1, 1).alias("u"), sampling.normal(5, 2, 2).alias("n"), sampling.exponential(0.5, 3).alias("e"), sampling.categorical({"a": 1, "b": 3}, 4).alias("c"), sampling.non_parametric([1, 2, 1], 10.0, 0.0, 5).alias("h"), sampling.random_text(6, 7).alias("s"), sampling.ranked(4, 9).alias("r"), sampling.uniform_int(1, 6, 10).alias("d"), sampling.poisson_events(2.0, 3, 11).alias("p")))
add("sample_balanced", lambda t: sampling.balance_classes(t.orders, "o_orderstatus"))
add("sample_stride", lambda t: sampling.stride_sample(t.orders, ["o_orderkey"], 10, 3))

# Streams: a file source drained with AvailableNow


def _drained(spark: SparkSession, directory: str, table: str, build, mode: str) -> DataFrame:
    """Run a streaming query over a table's files to its end and read what it wrote from the shared folder."""
    root = scratch(spark, "stream")
    path = f"{directory}/{table}.parquet"
    source = streams.directory(spark, path + "*", spark.read.parquet(path).schema, "parquet")
    out = f"{root}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.start(build(source), f"{root}/state", mode, each_batch=write)
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_tumbling(spark: SparkSession, directory: str) -> DataFrame:
    x = _drained(spark, directory, "events", lambda s: stream.tumbling(s, ["event_type"], "ts", ["value"], "6 hours", "30 days", "count"), "update")
    x = x.groupBy("event_type", "bucket", "attr").agg(F.max_by("count", "batch").alias("count"))
    return x.withColumn("bucket", F.unix_seconds("bucket"))


def stream_running(spark: SparkSession, directory: str) -> DataFrame:
    x = _drained(spark, directory, "events", lambda s: stream.running_stats(s, ["event_type"], ["value"]), "update")
    last = x.groupBy("event_type", "attr").agg(F.max_by(F.struct("count", "mean", "std_dev"), "batch").alias("r"))
    return last.select("event_type", "attr", "r.count", F.round("r.mean", 4).alias("mean"), F.round("r.std_dev", 4).alias("std_dev"))


def stream_recency(spark: SparkSession, directory: str) -> DataFrame:
    x = _drained(spark, directory, "events", lambda s: stream.recency_weighted(s, "event_type", "value", "event_id", 0.05), "update")
    return x.groupBy("key").agg(F.max_by(F.struct("average", "n"), "batch").alias("r")).select("key", "r.average", "r.n")


def stream_newest(spark: SparkSession, directory: str) -> DataFrame:
    """The newest event per user, kept batch by batch."""
    root = scratch(spark, "stream")
    path = f"{directory}/events.parquet"
    source = streams.directory(spark, path + "*", spark.read.parquet(path).schema, "parquet").select("user_id", "event_id", "event_type", "ts").where("user_id is not null")
    stream.start(source, f"{root}/state", "append", each_batch=stream.upsert_into(f"{root}/out", ["user_id"], "event_id")).awaitTermination()
    return stream.newest(spark.read.parquet(f"{root}/out"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


for _q in (stream_tumbling, stream_running, stream_recency, stream_newest):
    registry.queries[_q.__name__] = _q
registry.sql["stream_tumbling"] = "select event_type, cast(epoch_us(ts) // 1000000 - epoch_us(ts) // 1000000 % 21600 as bigint) bucket, 'value' attr, count(value) as count from events group by all"
registry.sql["stream_newest"] = "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events where user_id is not null group by 1"
registry.sql["stream_running"] = "select event_type, 'value' attr, count(value) as count, round(avg(value), 4) mean, round(stddev_pop(value), 4) std_dev from events group by 1"

QUERIES, SQL = registry.queries, registry.sql
