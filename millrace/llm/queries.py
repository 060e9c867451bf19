"""The pN_ queries of problems 2, 8, 9 and 10 and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import digest, mixing, packing, spans
from millrace.llm.tokens import token_sizes
from millrace.operators.common import broadcast_if_small, cut, written
from millrace.sources.tables import read

SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]
ERROR = 0.01
LENGTH = 200


# 2. Percentiles


def _daily_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of used per plan and loading day; deliveries count as delivered, as days are digested on their own."""
    u = read(spark, d, "usage_records")
    keys = {"plan_name": F.lower(F.trim("plan_name")), "day": F.to_date("loaded_at")}
    return digest.digests(u, keys, F.col("used"), ERROR)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: percentiles of every loading day, of every month and of all days, the latter two from the days' digests."""
    days = written(_daily_digests(spark, d))
    longer = F.array(F.struct(F.lit("month").alias("period"), F.trunc("day", "month").alias("start")), F.struct(F.lit("all").alias("period"), F.lit(None).cast("date").alias("start")))
    keys = ["plan_name", "period", "start"]
    x = days.select("plan_name", F.inline(longer), "height", "node", "n")
    found = digest.percentiles(digest.merge(x, {k: F.col(k) for k in keys}, ERROR), keys, SHARES, ERROR)
    daily = digest.percentiles(days, ["plan_name", "day"], SHARES, ERROR).withColumnRenamed("day", "start").withColumn("period", F.lit("day"))
    return daily.select(*found.columns).unionByName(found)


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The counts the digests hold per plan and loading day: exact, as compression moves counts and loses none."""
    return _daily_digests(spark, d).groupBy("plan_name", "day").agg(F.sum("n").alias("n"))


def _bound_check(found: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, share, n, within: the exact number of ``values`` (keys, v), and whether the answers' ranks keep their bound."""
    answers = found.groupBy(*keys).agg(F.collect_list(F.struct("share", "value", "max_rank_error")).alias("answers"))  # a row per share
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}"))
    counts = values.groupBy(*keys, "v").agg(F.count("*").alias("k"))
    x = counts.alias("c").join(broadcast_if_small(answers, 10_000).alias("a"), on).select(*[F.col(f"c.{k}") for k in keys], "v", "k", F.inline("answers"))
    x = x.groupBy(*keys, "share").agg(
        F.sum("k").alias("n"), F.max("max_rank_error").alias("e"), F.sum(F.when(F.col("v") < F.col("value"), F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto")
    )
    rank = F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1))
    return x.select(*keys, "share", "n", ((F.col("below") - F.col("e") < rank) & (rank <= F.col("upto") + F.col("e"))).alias("within"))


def p2_bound_check(spark: SparkSession, d: str) -> DataFrame:
    """Per plan and share, over all days: the exact number of values, and whether the digests' answer keeps the stated bound."""
    days = _daily_digests(spark, d)
    found = digest.percentiles(digest.merge(days, {"plan_name": F.col("plan_name")}, ERROR), ["plan_name"], SHARES, ERROR)
    u = read(spark, d, "usage_records").where("used is not null").select(F.lower(F.trim("plan_name")).alias("plan_name"), F.col("used").alias("v"))
    return _bound_check(found, u, ["plan_name"])


def p2_bound_check_months(spark: SparkSession, d: str) -> DataFrame:
    """The same per plan and loading month."""
    days = _daily_digests(spark, d)
    found = digest.percentiles(digest.merge(days, {"plan_name": F.col("plan_name"), "month": F.trunc("day", "month")}, ERROR), ["plan_name", "month"], SHARES, ERROR)
    u = read(spark, d, "usage_records").where("used is not null").select(F.lower(F.trim("plan_name")).alias("plan_name"), F.trunc(F.to_date("loaded_at"), "month").alias("month"), F.col("used").alias("v"))
    return _bound_check(found, u, ["plan_name", "month"])


def p2_bound_check_doubles(spark: SparkSession, d: str) -> DataFrame:
    """The same for fractions: the share of its order that a line item's tax and discount make, per return flag."""
    lines = read(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * F.col("l_tax")).cast("double").alias("v"))
    found = digest.percentiles(digest.digests(lines, {"l_returnflag": F.col("l_returnflag")}, F.col("v"), ERROR), ["l_returnflag"], SHARES, ERROR, "double")
    return _bound_check(found, lines.where("v is not null"), ["l_returnflag"])


P2_BOUND_SQL = f"select plan_name, unnest({SHARES})::double as share, n, true as within from (select lower(trim(plan_name)) plan_name, count(*) n from usage_records where used is not null group by 1)"
P2_BOUND_MONTHS_SQL = f"select plan_name, month, unnest({SHARES})::double as share, n, true as within from (select lower(trim(plan_name)) plan_name, cast(date_trunc('month', loaded_at) as date) as month, count(*) n from usage_records where used is not null group by all)"
P2_BOUND_DOUBLES_SQL = f"select l_returnflag, unnest({SHARES})::double as share, n, true as within from (select l_returnflag, count(l_discount * l_tax) n from lineitem group by 1)"
P2_SIZES_SQL = "select lower(trim(plan_name)) plan_name, cast(loaded_at as date) as day, count(*) n from usage_records where used is not null group by all"


# 8. Packing


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pack_sizes").select("pack_name", F.col("capacity_tokens").alias("capacity"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(token_sizes(read(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes, _packs(spark, d))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_containers(spark, d), _packs(spark, d))


SLACK = 0.01


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether every text is placed once, no container is over its capacity, only larger texts are split, and at most 1 % is free."""
    sizes = cut(token_sizes(read(spark, d, "documents"), "doc_id", "text"))
    return packing.check(written(packing.pack(sizes, _packs(spark, d))), sizes, _packs(spark, d), SLACK)


P8_CHECK_SQL = "select pack_name, (select count(text) from documents) texts, true placed_once, true within_capacity, true only_oversized_split, true slack_kept from pack_sizes"


# 9. Mixing


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    docs = read(spark, d, "documents").where("source is not null").select("doc_id", "source", "text", F.md5("text").alias("text_key"))
    targets = read(spark, d, "mix_targets")
    mixed, solution = mixing.mix(token_sizes(docs, "doc_id", "text", ["source", "text_key"]), targets)
    return mixed, targets, solution


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = _mixed(spark, d)[0]
    return mixed.where("copies > 0").withColumn("rate", F.round("rate", 6))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d)[:2])


SHARE_TOLERANCE = 0.002


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the dual is solved, no text exceeds its cap, shares are met within 0.2 points, and no larger total could be drawn."""
    return mixing.check(*_mixed(spark, d), SHARE_TOLERANCE)


P9_CHECK_SQL = """with t as (select text, arg_min(source, doc_id) source from documents join mix_targets on source = source_name where text <> '' group by text)
select source_name, (select count(*) from t where t.source = source_name) texts, true converged, true caps_kept, true share_kept, true largest_total from mix_targets"""


# 10. Shared spans


def _corpus(spark: SparkSession, d: str) -> spans.Corpus:
    return spans.Corpus(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return spans.document_pairs(spans.linked_texts(corpus, LENGTH), corpus, LENGTH)


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return spans.coverage(spans.shared_parts(corpus, LENGTH), corpus, LENGTH)


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared stretches, between class representatives (the smallest id among copies of a text)."""
    corpus = _corpus(spark, d)
    first = corpus.first.select("text_class", "doc_id")
    other = first.select(F.col("text_class").alias("other_class"), F.col("doc_id").alias("other_doc_id"))
    return spans.shared_spans(corpus, LENGTH).join(first, "text_class").join(other, "other_class").select("doc_id", "other_doc_id", "start", "n_chars")


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class of copies (the smallest id) and the number of other texts it shares a span with."""
    corpus = _corpus(spark, d)
    both = spans.linked_texts(corpus, LENGTH).select(F.explode(F.array("a", "b")).alias("text_class"))
    links = both.groupBy("text_class").agg(F.count("*").alias("links"))
    first = corpus.first.select("text_class", F.col("doc_id").alias("class_id"), "copies").join(links, "text_class", "left")
    return corpus.members.join(first, "text_class").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_bound_check, p2_bound_check_months, p2_bound_check_doubles, p2_sizes, p8_containers, p8_summary, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_links, p10_coverage, p10_spans)}
_WINDOWS = f"""w as (select doc_id, i, hash(substr(text, i, {LENGTH})) h from (select doc_id, text, unnest(generate_series(1, length(text) - {LENGTH - 1})) i from documents where length(text) >= {LENGTH})),
s as (select h from w group by h having count(distinct doc_id) > 1)"""
P10_FOUND_SQL = f"""with {_WINDOWS}, k as (select distinct doc_id, h from w semi join s using (h))
select distinct a.doc_id doc_id_1, b.doc_id doc_id_2 from k a join k b on a.h = b.h and a.doc_id < b.doc_id"""
P10_COVERAGE_SQL = f"""with {_WINDOWS}, p as (select doc_id, i, lead(i) over (partition by doc_id order by i) nx from w semi join s using (h)),
c as (select doc_id, sum(least(coalesce(nx - i, {LENGTH}), {LENGTH})) n from p group by 1)
select doc_id, length(text) n_chars, cast(coalesce(n, 0) as bigint) shared_chars, round(case when length(text) > 0 then coalesce(n, 0) / length(text) else 0 end, 6) shared_share from documents left join c using (doc_id) where text is not null"""
P10_LINKS_SQL = f"""with {_WINDOWS}, f as (select text, min(doc_id) class_id, count(*) copies from documents where text is not null group by 1),
k as (select distinct class_id, h from w semi join s using (h) join documents using (doc_id) join f using (text)),
l as (select a.class_id, count(distinct b.class_id) links from k a join k b on a.h = b.h and a.class_id <> b.class_id group by 1)
select doc_id, class_id, copies, coalesce(links, 0) links from documents join f using (text) left join l using (class_id)"""

P10_SPANS_SQL = f"""with {_WINDOWS}, f as (select text, min(doc_id) class_id from documents where text is not null group by 1),
k as (select w.doc_id, i, h from w semi join s using (h) semi join f on f.class_id = w.doc_id),
p as (select distinct a.doc_id, b.doc_id other_doc_id, a.i from k a join k b on a.h = b.h and a.doc_id <> b.doc_id),
o as (select *, case when i - lag(i) over (partition by doc_id, other_doc_id order by i) <= {LENGTH} then 0 else 1 end opens from p),
r as (select *, sum(opens) over (partition by doc_id, other_doc_id order by i) run from o)
select doc_id, other_doc_id, cast(min(i) - 1 as int) as start, cast(max(i) - min(i) + {LENGTH} as int) n_chars from r group by doc_id, other_doc_id, run"""

SQL = {"p9_check": P9_CHECK_SQL, "p8_check": P8_CHECK_SQL, "p10_spans": P10_SPANS_SQL, "p2_bound_check": P2_BOUND_SQL, "p2_bound_check_months": P2_BOUND_MONTHS_SQL, "p2_bound_check_doubles": P2_BOUND_DOUBLES_SQL, "p2_sizes": P2_SIZES_SQL, "p10_found": P10_FOUND_SQL, "p10_coverage": P10_COVERAGE_SQL, "p10_links": P10_LINKS_SQL}
