"""The pN_ queries of the core problems (1, 3 to 7) and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import column_profile as cp
from millrace.operators import nested, parse_rows, rolling
from millrace.operators.common import broadcast_if_small, epoch_ms, spelled, written
from millrace.operators.intervals import SHARD, clear_runs, run_bitmaps, set_runs
from millrace.operators.spikes import implausible
from millrace.sources.tables import read

LOADED = {"retail_orders": ["order_date", "store_id", "zip", "order_id", "product_id", "category", "quantity", "amount"], "electr_products": ["product_id", "category", "brand", "model", "price", "quantity"]}
PERIODS = [7, 30]


# 1. Column profiles of loads


def _judged(spark: SparkSession, d: str) -> DataFrame:
    cells = [cp.cells(read(spark, d, t), t, "feed_id", "load_seq", columns) for t, columns in LOADED.items()]
    return written(cp.judged(cp.value_counts(*cells), read(spark, d, "attr_schema")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cp.findings(_judged(spark, d), missing_step=0.102, shift_step=0.251).distinct()


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    s = cp.load_stats(_judged(spark, d))
    return s.select(*cp.LOAD, "rows", "missing", F.round("missing_share", 6).alias("missing_share"), "distinct_values", "low", "high", "median", "out_of_range", "non_member", "bad_length", "bad_pattern")


def p1_load_changes(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    c = cp.share_changes(j, written(cp.load_stats(j)))
    return c.select(*cp.LOAD, *[F.round(x, 6).alias(x) for x in ("largest_shift", "chi_square", "psi")])


_CELLS = " union all ".join(
    f"select '{t}' table_name, feed_id, load_seq, '{c}' column_name, cast({c} as varchar) as v, {f'cast({c} as double)' if c in ('quantity', 'amount', 'price') else 'cast(null as double)'} as num from {t}"
    for t, columns in LOADED.items()
    for c in columns
)
_JUDGED = f"""cells as ({_CELLS}),
j as (select c.*, s.members, s.members is not null as closed,
  (v is null or trim(v, ' \t\r\n') = '' or list_contains(list_transform(s.missing_tags, lambda x: lower(x)), lower(trim(v, ' \t\r\n')))) as miss,
  coalesce(num < s.min_value, false) or coalesce(num > s.max_value, false) or coalesce(s.data_type = 'date' and try_cast(v as date) < cast(s.earliest_date as date), false) as b_range,
  coalesce(not list_contains(s.members, v), false) as b_member,
  coalesce(length(v) <> s.exact_length, false) as b_length,
  coalesce(not regexp_full_match(v, s.string_pattern), false) as b_pattern
  from cells c join attr_schema s on s.schema_name = c.table_name and s.attr_name = c.column_name),
st as (select table_name, feed_id, load_seq, column_name, count(*) n_rows, count(*) filter (miss) missing,
  count(distinct v) filter (not miss) dis, min(num) low, max(num) high, median(num) med,
  count(*) filter (not miss and b_range) n_range, count(*) filter (not miss and b_member) n_member,
  count(*) filter (not miss and b_length) n_length, count(*) filter (not miss and b_pattern) n_pattern
  from j group by all),
vc as (select table_name, feed_id, load_seq, column_name, v, count(*) n from j where closed and not miss group by all),
pr as (select a.table_name, a.feed_id, a.load_seq, a.column_name, a.n_rows - a.missing fa, b.n_rows - b.missing fb from st a join st b
  on a.table_name = b.table_name and a.feed_id = b.feed_id and a.column_name = b.column_name and a.load_seq = b.load_seq + 1
  where a.n_rows > a.missing and b.n_rows > b.missing),
sides as (select table_name, feed_id, load_seq, column_name, v, sum(x) a, sum(y) b from
  (select table_name, feed_id, load_seq, column_name, v, n x, 0 y from vc union all select table_name, feed_id, load_seq + 1, column_name, v, 0, n from vc) group by all),
ch as (select p.table_name, p.feed_id, p.load_seq, p.column_name, max(abs(a / fa - b / fb)) largest_shift,
  sum(pow(a - (a + b) * fa / (fa + fb), 2) / ((a + b) * fa / (fa + fb)) + pow(b - (a + b) * fb / (fa + fb), 2) / ((a + b) * fb / (fa + fb))) chi_square,
  sum((greatest(a / fa, 0.0001) - greatest(b / fb, 0.0001)) * ln(greatest(a / fa, 0.0001) / greatest(b / fb, 0.0001))) psi
  from pr p join sides s using (table_name, feed_id, load_seq, column_name) group by all)"""
P1_FOUND_SQL = f"""with {_JUDGED},
m as (select a.*, b.n_rows brows, b.missing bmissing, b.dis bdis, b.med bmed from st a left join st b
  on a.table_name = b.table_name and a.feed_id = b.feed_id and a.column_name = b.column_name and a.load_seq = b.load_seq + 1)
select table_name, feed_id, load_seq, column_name, finding from (
 select *, 'range' finding from m where n_range > 0 union all select *, 'member' from m where n_member > 0
 union all select *, 'length' from m where n_length > 0 union all select *, 'pattern' from m where n_pattern > 0
 union all select *, 'missing' from m where abs(missing / n_rows - bmissing / brows) > 0.102
 union all select *, 'distinct' from m where dis > 2 * bdis or 2 * dis < bdis
 union all select *, 'shift' from m where med > 2 * bmed or 2 * med < bmed)
union select table_name, feed_id, load_seq, column_name, 'shift' from ch where largest_shift > 0.251"""
P1_PROFILE_SQL = f"""with {_JUDGED} select table_name, feed_id, load_seq, column_name, n_rows as rows, missing, round(missing / n_rows, 6) missing_share,
 dis distinct_values, low, high, med as median, n_range out_of_range, n_member non_member, n_length bad_length, n_pattern bad_pattern from st"""
P1_CHANGES_SQL = f"""with {_JUDGED} select table_name, feed_id, load_seq, column_name, round(largest_shift, 6) largest_shift, round(chi_square, 6) chi_square, round(psi, 6) psi from ch"""


# 3. Periods of use and gaps


def _bitmaps(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "usage_records")
    return run_bitmaps(u, spelled(F.col("device_id")), epoch_ms(u, "start_time"), epoch_ms(u, "end_time"), SHARD)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clear_runs(_bitmaps(spark, d)).select(F.col("entity").alias("device_id"), F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    return set_runs(_bitmaps(spark, d), SHARD).select(F.col("entity").alias("device_id"), F.col("period_start").alias("period_start_ms"), F.col("period_end").alias("period_end_ms"))


_RUNS = """u as (select upper(trim(device_id)) device_id, epoch_ms(start_time) s, epoch_ms(end_time) e from usage_records
  where device_id is not null and start_time is not null and end_time > start_time),
m as (select *, max(e) over (partition by device_id order by s, e rows between unbounded preceding and 1 preceding) reach from u),
k as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by device_id order by s, e) run from m),
r as (select device_id, run, min(s) s, max(e) e from k group by all)"""
P3_FOUND_SQL = f"""with {_RUNS}, g as (select device_id, e gap_start_ms, lead(s) over (partition by device_id order by s) gap_end_ms from r)
select device_id, gap_start_ms, gap_end_ms from g where gap_end_ms is not null"""
P3_PERIODS_SQL = f"with {_RUNS} select device_id, s period_start_ms, e period_end_ms from r"


# 4. Nested records


def _usage_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.label_nodes(read(spark, d, "usage_docs"), "raw_id", "payload", ["datausage", "usages"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    usage = nested.parent_child(read(spark, d, "usage_docs"), "raw_id", "payload", "datausage", "usages", "acctid", "deviceid")
    event = nested.parent_child(read(spark, d, "sm_event_docs"), "raw_id", "payload", "entity", "eventdata", "id", "eventcode", key_node="metadata")
    both = usage.withColumn("doc_kind", F.lit("usage")).unionByName(event.withColumn("doc_kind", F.lit("event")))
    return both.select("doc_kind", F.col("doc_id").alias("raw_id"), "parent_pos", "parent_key", "child_pos", "child_key")


def p4_usages(spark: SparkSession, d: str) -> DataFrame:
    """The child table of usages, each with its label and that of its account."""
    f = F.col("fields")
    x = nested.link(_usage_nodes(spark, d), "datausage", "usages")
    numbers = [f["used"].try_cast("long").alias("used"), f["starttime"].try_cast("long").alias("start_ms"), f["endtime"].try_cast("long").alias("end_ms")]
    return x.select("doc_id", "parent_pre", "pre", "pos", f["deviceid"].alias("device_id"), f["plan"].alias("plan_name"), *numbers)


def p4_accounts(spark: SparkSession, d: str) -> DataFrame:
    """The parent table of accounts."""
    f = F.col("fields")
    x = _usage_nodes(spark, d).where("node_type = 'datausage'")
    return x.select("doc_id", "pre", "pos", f["acctid"].alias("acct_id"), f["email"].alias("email"), f["phonenum"].alias("phone"))


def p4_self_parent(spark: SparkSession, d: str) -> DataFrame:
    """Units that hold units of their own type, and items on both levels: every item with its own unit."""
    nations = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    item = lambda c: F.array(F.struct(c.cast("string").alias("id")))
    inner = F.transform("ns", lambda n: F.struct(n["n_name"].alias("name"), item(n["n_nationkey"]).alias("item")))
    unit = F.struct(F.col("r_name").alias("name"), inner.alias("unit"), item(F.col("r_regionkey") + 1000).alias("item"))
    docs = read(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.to_json(F.struct(unit.alias("unit"))).alias("payload"))
    return nested.parent_child(docs, "r_regionkey", "payload", "unit", "item", "name", "id")


def _members(nodes: str, key: str) -> str:
    """SQL: every object with its list's name (or its own), place, and the object that holds it."""
    return f"""select o.{key}, o.id, case when p.type = 'ARRAY' then p.lk else o.lk end nm, case when p.type = 'ARRAY' then cast(o.k as int) else 0 end pos, case when p.type = 'ARRAY' then p.parent else o.parent end holder
  from {nodes} o left join {nodes} p on p.{key} = o.{key} and p.id = o.parent where o.type = 'OBJECT'"""


def _tree(table: str, key: str, text: str) -> str:
    return f"select {key}, t.key k, lower(t.key) lk, t.type, t.id, t.parent, t.value as val, t.atom ->> '$' txt from {table}, json_tree({text}) t where json_valid({text})"


_SCALAR = "type not in ('OBJECT', 'ARRAY', 'NULL')"
P4_FOUND_SQL = f"""with u as materialized ({_tree("usage_docs", "raw_id", "payload")}), um as materialized ({_members("u", "raw_id")}),
ux as materialized (select p.raw_id, p.pos pp, c.pos cp, p.id pid, c.id cid from um p left join um c on c.raw_id = p.raw_id and c.holder = p.id and c.nm = 'usages' where p.nm = 'datausage'),
ur as materialized (select 'usage' doc_kind, x.raw_id, pp, coalesce(a.txt, '') pk, coalesce(cp, -1) cp, coalesce(b.txt, '') ck from ux x
  left join (select * from u where lk = 'acctid' and {_SCALAR}) a on a.raw_id = x.raw_id and a.parent = pid left join (select * from u where lk = 'deviceid' and {_SCALAR}) b on b.raw_id = x.raw_id and b.parent = cid),
e as materialized ({_tree("sm_event_docs", "raw_id", "payload")}), em as materialized ({_members("e", "raw_id")}),
ep as materialized (select raw_id || ':' || id ek, raw_id, id, pos from em where nm = 'entity'),
ek as materialized (select p.ek, i.txt from ep p join e m on m.raw_id = p.raw_id and m.parent = p.id and m.lk = 'metadata' and m.type = 'OBJECT' join e i on i.raw_id = m.raw_id and i.parent = m.id and i.lk = 'id' and i.{_SCALAR}),
ed as materialized (select p.ek, case when d.type = 'OBJECT' then cast(d.val as varchar) else d.txt end dt from ep p join e d on d.raw_id = p.raw_id and d.parent = p.id and d.lk = 'data' and d.type in ('OBJECT', 'VARCHAR')),
v as materialized ({_tree("ed", "ek", "dt")}), vm as materialized ({_members("v", "ek")}),
er as materialized (select 'event' doc_kind, p.raw_id, p.pos pp, coalesce(ek.txt, '') pk, coalesce(c.pos, -1) cp, coalesce(t.txt, '') ck from ep p left join ek on ek.ek = p.ek
  left join (select * from vm where nm = 'eventdata') c on c.ek = p.ek left join (select * from v where lk = 'eventcode' and {_SCALAR}) t on t.ek = p.ek and t.parent = c.id)
select doc_kind, raw_id, cast(pp as int) parent_pos, pk parent_key, cast(cp as int) child_pos, ck child_key from (select * from ur union all select * from er)"""
_OBJECTS = f"""u as materialized ({_tree("usage_docs", "raw_id", "payload")}), um as materialized ({_members("u", "raw_id")}),
n as materialized (select *, cast(row_number() over (partition by raw_id order by id) - 1 as int) pre from um),
s as materialized (select raw_id, parent, lk, txt from u where {_SCALAR})"""
P4_USAGES_SQL = f"""with {_OBJECTS}, x as (select c.raw_id, c.id, p.pre parent_pre, c.pre, c.pos from n c join n p on p.raw_id = c.raw_id and p.id = c.holder where p.nm = 'datausage' and c.nm = 'usages')
select x.raw_id doc_id, parent_pre, pre, pos, max(txt) filter (lk = 'deviceid') device_id, max(txt) filter (lk = 'plan') plan_name, max(try_cast(txt as bigint)) filter (lk = 'used') used,
 max(try_cast(txt as bigint)) filter (lk = 'starttime') start_ms, max(try_cast(txt as bigint)) filter (lk = 'endtime') end_ms
from x left join s on s.raw_id = x.raw_id and s.parent = x.id group by x.raw_id, x.id, parent_pre, pre, pos"""
P4_ACCOUNTS_SQL = f"""with {_OBJECTS} select n.raw_id doc_id, pre, pos, max(txt) filter (lk = 'acctid') acct_id, max(txt) filter (lk = 'email') email, max(txt) filter (lk = 'phonenum') phone
from n left join s on s.raw_id = n.raw_id and s.parent = n.id where nm = 'datausage' group by n.raw_id, n.id, pre, pos"""
P4_SELF_SQL = """select cast(r_regionkey as bigint) doc_id, 0 parent_pos, r_name parent_key, 0 child_pos, cast(r_regionkey + 1000 as varchar) child_key from region where r_regionkey in (select n_regionkey from nation)
union all select n_regionkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int), n_name, 0, cast(n_nationkey as varchar) from nation"""


# 5. Readings to distrust


def _marks(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "usage_records")
    limits = broadcast_if_small(read(spark, d, "plan_limits").select(F.lower(F.trim("plan_name")).alias("plan"), "max_bytes_per_sec"), 10_000)
    start, end = epoch_ms(u, "start_time"), epoch_ms(u, "end_time")
    x = u.where("device_id is not null and used is not null")
    x = x.select("usage_id", spelled(F.col("device_id")).alias("device"), "used", start.alias("s"), end.alias("e"), F.lower(F.trim("plan_name")).alias("plan"))
    x = x.join(limits, "plan", "left")
    most = F.col("max_bytes_per_sec").cast("decimal(19,0)") * (F.col("e") - F.col("s")) / 1000
    over = (F.col("e") > F.col("s")) & (F.col("used").cast("decimal(19,0)") > most)
    bad = (F.col("used") < 0) | F.coalesce(over, F.lit(False))
    return implausible(x, F.col("usage_id"), F.col("device"), F.col("used"), F.col("s"), bad, reach=8.0, min_run=6)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = _marks(spark, d)
    far = (F.col("spike_round") == 1) & (F.col("n") >= 20) & (F.abs(F.col("value") - F.col("median")) > 8 * F.col("deviation"))
    return m.where(F.col("impossible") | F.col("stuck") | far).select(F.col("ident").alias("usage_id")).distinct()


def p5_phase_space(spark: SparkSession, d: str) -> DataFrame:
    """All flags of the operator, with the round in which a spike was found."""
    m = _marks(spark, d)
    return m.select(F.col("ident").alias("usage_id"), F.col("source").alias("device_id"), "value", "n", "median", "deviation", "spike_round", "stuck", "impossible")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Per device: readings that are flagged as impossible, stuck, and in round 1 for being far out, against plain SQL."""
    far = (F.col("spike_round") == 1) & (F.abs(F.col("value") - F.col("median")) > 8 * F.col("deviation"))
    many = lambda c: F.sum(c.cast("int"))
    x = _marks(spark, d).where(F.col("stuck") | F.col("impossible") | far)
    return x.groupBy(F.col("source").alias("device_id")).agg(F.max("n").alias("readings"), F.max("median").alias("median"), F.max("deviation").alias("deviation"), many(far).alias("far"), many(F.col("stuck")).alias("stuck"), many(F.col("impossible")).alias("impossible"))


_P5 = """with u as (select usage_id, any_value(upper(trim(device_id))) dev, any_value(used) used, any_value(start_time) s, any_value(end_time) e, any_value(lower(trim(plan_name))) plan
  from usage_records where device_id is not null and used is not null group by usage_id),
md as (select dev, count(*) n, median(used) med from u group by dev),
mad as (select dev, median(abs(used - med)) mad from u join md using (dev) group by dev),
q as (select *, case when lag(used) over w = used then 0 else 1 end opens from u where s is not null window w as (partition by dev order by s, usage_id)),
k as (select *, sum(opens) over (partition by dev order by s, usage_id) run from q),
z as (select *, count(*) over (partition by dev, run) len from k)"""
P5_FOUND_SQL = f"""{_P5}
select usage_id from u where used < 0
union select usage_id from u join plan_limits p on lower(trim(p.plan_name)) = u.plan where e > s and used > p.max_bytes_per_sec::hugeint * (epoch_ms(e) - epoch_ms(s)) / 1000
union select usage_id from z where len >= 6 and used > 0
union select usage_id from u join md using (dev) join mad using (dev) where n >= 20 and abs(used - med) > 8 * mad"""
P5_CHECK_SQL = f"""{_P5},
f as (select u.usage_id, dev, n, med, mad, abs(used - med) > 8 * mad as far, coalesce(len >= 6 and u.used > 0, false) as stuck,
  used < 0 or coalesce(e > u.s and used > p.max_bytes_per_sec::hugeint * (epoch_ms(e) - epoch_ms(u.s)) / 1000, false) as bad
  from u join md using (dev) join mad using (dev) left join (select usage_id, len from z) k using (usage_id) left join plan_limits p on lower(trim(p.plan_name)) = u.plan)
select dev device_id, max(n) readings, max(med) as median, max(mad) deviation, count(*) filter (far) as far, count(*) filter (stuck) as stuck, count(*) filter (bad) as impossible from f where far or stuck or bad group by dev"""


# 6. Lines that fail to parse


def _line_rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rules = read(spark, d, "attr_schema").where("schema_name = 'retail_orders'").drop("schema_name", "missing_tags", "date_pattern")
    known = read(spark, d, "product_max").select(F.lit("product_id").alias("attr_name"), F.col("product_id").alias("value"))
    return read(spark, d, "retail_order_lines"), rules, known


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines, rules, known = _line_rules(spark, d)
    return parse_rows.failures(lines, "raw_id", "line_text", rules, known).select("raw_id", "reason")


def p6_sound_rows(spark: SparkSession, d: str) -> DataFrame:
    lines, rules, known = _line_rules(spark, d)
    return parse_rows.sound_rows(lines, "raw_id", "line_text", rules, known)


_FIELD = """([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)"""
_LINES = f"""l as (select raw_id, coalesce(line_text, '') t from retail_order_lines),
q as (select raw_id, t, regexp_full_match(t, '{_FIELD}(,{_FIELD})*', 's') ok from l),
f as (select raw_id, ok, case when ok then list_transform(regexp_extract_all(',' || t, ',{_FIELD}', 1, 's'),
  lambda x: trim(case when regexp_full_match(x, '[ \t]*".*"[ \t]*', 's') then replace(regexp_extract(x, '^[ \t]*"(.*)"[ \t]*$', 1, 's'), '""', '"') else x end, ' \t')) end c from q),
r as (select max(earliest_date) filter (attr_name = 'order_date') early, max(exact_length) filter (attr_name = 'store_id') len,
  any_value(members) filter (attr_name = 'zip') zips, any_value(members) filter (attr_name = 'category') cats, max(string_pattern) filter (attr_name = 'order_id') pat,
  max(min_value) filter (attr_name = 'quantity') lo, max(max_value) filter (attr_name = 'amount') hi from attr_schema where schema_name = 'retail_orders'),
v as (select raw_id, c, case when not ok then 'quoting' when len(c) <> 8 then 'column_count'
  when not (regexp_full_match(c[1], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and coalesce(try_cast(c[1] as date) >= cast(early as date), false)
   and length(c[2]) = r.len and list_contains(zips, c[3]) and list_contains(cats, c[6]) and regexp_full_match(c[4], pat)
   and c[5] in (select product_id from product_max)
   and regexp_full_match(c[7], '[+-]?[0-9]+') and coalesce(try_cast(c[7] as hugeint) between greatest(lo, -2147483648) and 2147483647, false)
   and regexp_full_match(c[8], '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') and coalesce(try_cast(c[8] as double) <= hi, false)) then 'invalid_value' end reason from f, r)"""
P6_FOUND_SQL = f"with {_LINES} select raw_id, reason from v where reason is not null"
P6_SOUND_SQL = f"""with {_LINES} select raw_id, cast(c[1] as date) order_date, c[2] store_id, c[3] zip, c[4] order_id, c[5] product_id, c[6] category,
 cast(c[7] as int) quantity, cast(c[8] as double) amount from v where reason is null"""


# 7. Rolling totals


def _daily(u: DataFrame) -> DataFrame:
    x = u.where("used > 0").select("usage_id", "acct_id", F.to_date("start_time").alias("usage_day"), "used")
    return rolling.daily_amounts(x, F.col("acct_id"), F.col("usage_day"), F.col("used"), F.col("usage_id"))


#: Loading days that come as a second batch.
LAST_LOADS = 30


def _advanced(spark: SparkSession, d: str) -> DataFrame:
    """The newest state after two batches: the records up to the last 30 loading days, and those days' arrivals."""
    u = read(spark, d, "usage_records")
    last = u.agg(F.date_sub(F.to_date(F.max("loaded_at")), LAST_LOADS)).collect()[0][0]
    x = u.where("used > 0").select("usage_id", "acct_id", F.to_date("start_time").alias("usage_day"), "used", (F.to_date("loaded_at") > F.lit(last)).alias("late"))
    daily = written(rolling.daily_amounts(x, F.col("acct_id"), F.col("usage_day"), F.col("used"), F.col("usage_id"), F.col("late")))
    first, arrivals = (daily.where(F.col("batch") == k).drop("batch") for k in (0, 1))
    base = written(rolling.rolling_state(first, PERIODS))
    return rolling.current(base.unionByName(rolling.advance(base, arrivals, PERIODS, 2, newest_only=True)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    days = rolling.every_day(_advanced(spark, d), PERIODS)
    surge = (F.datediff("day", "first_day") >= 29) & (F.col("t7") * 30 > F.col("t30") * 28)
    kind = F.when((F.col("t7") == 0) & (F.col("t30") != 0), "idle").when(surge, "surge")
    found = days.select(F.col("entity").alias("acct_id"), F.date_format("day", "yyyy-MM-dd").alias("usage_day"), kind.alias("finding"))
    return found.where("finding is not null")


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    days = rolling.every_day(rolling.rolling_state(_daily(read(spark, d, "usage_records")), PERIODS), PERIODS)
    means = [F.round(F.col(f"t{n}").cast("double") / n, 3).alias(f"mean_{n}") for n in PERIODS]
    return days.select(F.col("entity").alias("acct_id"), F.col("day").alias("usage_day"), *[F.col(f"t{n}").cast("double").alias(f"total_{n}") for n in PERIODS], *means)


def p7_versions(spark: SparkSession, d: str) -> DataFrame:
    """The state loaded in two batches: records first loaded by the end of March, then the rest as corrections."""
    u = read(spark, d, "usage_records").where("used > 0 and acct_id is not null and start_time is not null")
    first = u.groupBy("usage_id").agg(F.max("acct_id").alias("acct_id"), F.max(F.to_date("start_time")).alias("usage_day"), F.max("used").alias("used"), F.min("loaded_at").alias("loaded_at"))
    early = F.col("loaded_at") < F.lit("2024-04-01").cast("timestamp_ntz")
    daily = [rolling.daily_amounts(first.where(c), F.col("acct_id"), F.col("usage_day"), F.col("used")) for c in (early, ~early)]
    base = rolling.rolling_state(daily[0], PERIODS)
    state = base.unionByName(rolling.advance(base, daily[1], PERIODS, 2))
    now = rolling.current(state)
    return now.select(F.col("entity").alias("acct_id"), F.col("day").alias("usage_day"), *[F.col(f"t{n}").cast("double").alias(f"total_{n}") for n in PERIODS])


_DAYS = """u as (select usage_id, any_value(acct_id) acct_id, any_value(cast(start_time as date)) dd, any_value(used) used from usage_records
  where used > 0 and acct_id is not null and start_time is not null group by usage_id),
a as (select acct_id, dd, sum(used) x from u group by all),
b as (select acct_id, min(dd) lo, max(dd) hi from a group by all),
g as (select acct_id, lo, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) dd from b),
t as (select acct_id, lo, dd, sum(coalesce(x, 0)) over (partition by acct_id order by dd rows between 6 preceding and current row) t7,
  sum(coalesce(x, 0)) over (partition by acct_id order by dd rows between 29 preceding and current row) t30 from g left join a using (acct_id, dd))"""
P7_FOUND_SQL = f"""with {_DAYS} select acct_id, strftime(dd, '%Y-%m-%d') usage_day, case when t7 = 0 and t30 <> 0 then 'idle' else 'surge' end finding from t
where (t7 = 0 and t30 <> 0) or (dd - lo >= 29 and t7 * 30 > t30 * 28)"""
P7_ROLLING_SQL = f"with {_DAYS} select acct_id, dd usage_day, cast(t7 as double) total_7, cast(t30 as double) total_30, round(cast(t7 as double) / 7, 3) mean_7, round(cast(t30 as double) / 30, 3) mean_30 from t"
P7_VERSIONS_SQL = """with u as (select usage_id, any_value(acct_id) acct_id, any_value(cast(start_time as date)) dd, any_value(used) used from usage_records
  where used > 0 and acct_id is not null and start_time is not null group by usage_id),
a as (select acct_id, dd, sum(used) x from u group by all),
p as (select distinct acct_id, dd + k dd from a, (values (0), (7), (30)) v(k)),
c as (select p.acct_id, p.dd, a.dd ad, a.x from p join a on a.acct_id = p.acct_id and a.dd <= p.dd and a.dd > p.dd - 30)
select p.acct_id, p.dd usage_day, cast(coalesce(sum(x) filter (ad > p.dd - 7), 0) as double) total_7, cast(coalesce(sum(x), 0) as double) total_30
from p left join c on c.acct_id = p.acct_id and c.dd = p.dd group by all"""

QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_load_changes, p3_found, p3_periods, p4_found, p4_usages, p4_accounts, p4_self_parent, p5_found, p5_phase_space, p5_check, p6_found, p6_sound_rows, p7_found, p7_rolling, p7_versions)}
SQL = {
    "p1_found": P1_FOUND_SQL, "p1_profile": P1_PROFILE_SQL, "p1_load_changes": P1_CHANGES_SQL, "p3_found": P3_FOUND_SQL, "p3_periods": P3_PERIODS_SQL, "p4_found": P4_FOUND_SQL, "p4_usages": P4_USAGES_SQL, "p4_accounts": P4_ACCOUNTS_SQL, "p4_self_parent": P4_SELF_SQL, "p5_found": P5_FOUND_SQL, "p5_check": P5_CHECK_SQL,
    "p6_found": P6_FOUND_SQL, "p6_sound_rows": P6_SOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_rolling": P7_ROLLING_SQL, "p7_versions": P7_VERSIONS_SQL,
}
