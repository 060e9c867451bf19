"""Exact column profiles per load, and changes between successive loads.

Every column is unpivoted to (load, column, value) and counted with partial aggregation; frequencies, missing shares,
distinct counts, ranges and rule breaches are all aggregates of these counts, each distinct value being judged once.
Medians come from the distributed exact medians over the counts. Loads are compared by putting each load's figures,
and each value's counts, beside those of the load before: by a shift of the sequence number and one aggregation, so a
feed with a third of all loads stays spread over its loads.

A load is (table, feed, sequence number); null feeds or numbers form loads of their own, without a load before.
Missing is null, blank, or a declared tag regardless of case and outer blanks; other values are taken as they stand.
Columns without a rule are not profiled; a load whose rows are all missing has distinct count 0 and no range, median
or shift. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.common import broadcast_if_small, written
from millrace.operators.quantiles import exact_medians

LOAD = ["table_name", "feed_id", "load_seq", "column_name"]
SMALL = 1e-4


def cells(df: DataFrame, table: str, feed: str, seq: str, columns: list[str]) -> DataFrame:
    """table_name, feed_id, load_seq, column_name, value (string): the named columns unpivoted."""
    x = df.select(F.col(feed).alias("feed_id"), F.col(seq).cast("int").alias("load_seq"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("value")) for i, c in enumerate(columns)])
    return x.select(F.lit(table).alias("table_name"), "feed_id", "load_seq", F.inline(pairs))


def value_counts(*tables: DataFrame) -> DataFrame:
    """table_name, feed_id, load_seq, column_name, value, n over the cells of all tables."""
    return reduce(DataFrame.unionByName, tables).groupBy(*LOAD, "value").agg(F.count("*").alias("n"))


def judged(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """The counts with what the rules say of each value: missing, number, out_of_range, non_member, bad_length, bad_pattern.

    ``rules``: a row per declared column; patterns become part of the plan, so that each is compiled once.
    """
    r = rules.select(
        F.col("schema_name").alias("table_name"), F.col("attr_name").alias("column_name"), "data_type", F.to_date("earliest_date").alias("_early"), "min_value", "max_value", "exact_length", "members",
        F.transform("missing_tags", F.lower).alias("_tags"), "string_pattern",
    )
    patterns = r.where("string_pattern is not null").select("table_name", "column_name", "string_pattern").distinct().limit(10_001).collect()
    if len(patterns) > 10_000:
        raise ValueError("more than 10,000 patterns")
    x = counts.join(broadcast_if_small(r.drop("string_pattern"), 10_000), ["table_name", "column_name"])
    v = F.col("value")
    trimmed = F.btrim(v, F.lit(" \t\r\n"))
    x = x.withColumn("missing", v.isNull() | (trimmed == "") | F.coalesce(F.array_contains("_tags", F.lower(trimmed)), F.lit(False)))
    x = x.withColumn("number", F.when(~F.col("missing") & F.col("data_type").isin("int", "long", "float", "double"), v.try_cast("double")))
    early = F.when(F.col("data_type") == "date", v.try_cast("date") < F.col("_early"))
    no = F.lit(False)
    present = ~F.col("missing")
    breach = lambda c: present & F.coalesce(c, no)
    matched = F.lit(None).cast("boolean")
    for p in patterns:
        own = (F.col("table_name") == p["table_name"]) & (F.col("column_name") == p["column_name"])
        matched = F.when(own, v.rlike(f"^(?:{p['string_pattern']})\\z")).otherwise(matched)
    return x.select(
        *LOAD,
        "value",
        "n",
        "missing",
        "number",
        F.col("members").isNotNull().alias("closed"),
        breach((F.col("number") < F.col("min_value")) | F.coalesce(F.col("number") > F.col("max_value"), no) | F.coalesce(early, no)).alias("out_of_range"),
        breach(~F.array_contains("members", v)).alias("non_member"),
        breach(F.length(v) != F.col("exact_length")).alias("bad_length"),
        breach(~matched).alias("bad_pattern"),
    )


def load_stats(judged_counts: DataFrame) -> DataFrame:
    """Per load and column: rows, missing, filled, missing_share, distinct_values, low, high, breaches, median.

    ``judged_counts`` is read three times: write it first.
    """
    ok = ~F.col("missing")
    many = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    s = judged_counts.groupBy(*LOAD).agg(
        F.sum("n").alias("rows"),
        many("missing").alias("missing"),
        F.count(F.when(ok, 1)).alias("distinct_values"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        many("out_of_range").alias("out_of_range"),
        many("non_member").alias("non_member"),
        many("bad_length").alias("bad_length"),
        many("bad_pattern").alias("bad_pattern"),
    )
    # A load has a row here and one there: put beside each other by one aggregation.
    figures = s.columns[len(LOAD) :]
    med = exact_medians(judged_counts.where("number is not null"), LOAD, "number", "n", counted=True).drop("n")
    both = s.withColumn("median", F.lit(None).cast("double")).unionByName(med, allowMissingColumns=True)
    s = both.groupBy(*LOAD).agg(*[F.max(c).alias(c) for c in [*figures, "median"]])
    return s.withColumn("filled", F.col("rows") - F.col("missing")).withColumn("missing_share", F.col("missing") / F.col("rows"))


def beside_previous(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Each load's ``fields`` beside those of the load before: keys, now (struct), before (struct or null)."""
    row = F.struct(*fields)
    both = F.array(
        F.struct(F.col("load_seq").alias("load_seq"), row.alias("now"), F.lit(None).cast(_struct(df, fields)).alias("before")),
        F.struct((F.col("load_seq") + 1).alias("load_seq"), F.lit(None).cast(_struct(df, fields)).alias("now"), F.when(F.col("feed_id").isNotNull() & F.col("load_seq").isNotNull(), row).alias("before")),
    )
    rest = [k for k in keys if k != "load_seq"]
    x = df.select(*rest, F.inline(both))
    return x.groupBy(*keys).agg(F.max("now").alias("now"), F.max("before").alias("before"))


def _struct(df: DataFrame, fields: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"{f}:{kinds[f]}" for f in fields) + ">"


def share_changes(judged_counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Changes of the value distribution of closed columns against the load before.

    Per load and column: largest_shift (of any value's share of the filled values), chi_square (of the two loads'
    counts, over values present in either) and psi (population stability index, shares below 0.0001 raised to it).
    """
    c = judged_counts.where("closed and not missing").select(*LOAD, "value", "n")
    c = beside_previous(c, ["n"], [*LOAD, "value"]).select(*LOAD, "value", F.coalesce("now.n", F.lit(0)).alias("a"), F.coalesce("before.n", F.lit(0)).alias("b"))
    totals = beside_previous(stats.select(*LOAD, "filled"), ["filled"], LOAD).where("now.filled > 0 and before.filled > 0")
    totals = totals.select(*LOAD, F.col("now.filled").alias("fa"), F.col("before.filled").alias("fb"))
    x = c.join(totals, LOAD)
    p, q = F.col("a") / F.col("fa"), F.col("b") / F.col("fb")
    both, all_ = F.col("a") + F.col("b"), F.col("fa") + F.col("fb")
    ea, eb = both * F.col("fa") / all_, both * F.col("fb") / all_
    pp, qq = F.greatest(p, F.lit(SMALL)), F.greatest(q, F.lit(SMALL))
    return x.groupBy(*LOAD).agg(
        F.max(F.abs(p - q)).alias("largest_shift"),
        F.sum((F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb).alias("chi_square"),
        F.sum((pp - qq) * F.log(pp / qq)).alias("psi"),
    )


def findings(judged_counts: DataFrame, missing_step: float, shift_step: float, factor: float = 2.0) -> DataFrame:
    """table_name, feed_id, load_seq, column_name, finding: breaches of the rules and changes from the load before.

    range, member, length, pattern: a filled value breaks the rule. missing: the missing share moved by more than
    ``missing_step``. distinct: the distinct count is above ``factor`` times or below 1/factor of the last. shift: a
    value's share in a closed column moved by more than ``shift_step``, or a numeric median by more than ``factor``.
    """
    stats = written(load_stats(judged_counts))  # a row per load and column
    kept = ["filled", "missing_share", "distinct_values", "median", "out_of_range", "non_member", "bad_length", "bad_pattern"]
    both = beside_previous(stats, kept, LOAD).where("now is not null")
    moved = lambda a, b: (F.col(a) > factor * F.col(b)) | (F.col(a) * factor < F.col(b))
    found = {
        "range": F.col("now.out_of_range") > 0,
        "member": F.col("now.non_member") > 0,
        "length": F.col("now.bad_length") > 0,
        "pattern": F.col("now.bad_pattern") > 0,
        "missing": F.abs(F.col("now.missing_share") - F.col("before.missing_share")) > missing_step,
        "distinct": moved("now.distinct_values", "before.distinct_values"),
        "shift": moved("now.median", "before.median"),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in found.items()]))
    direct = both.select(*LOAD, F.explode(names).alias("finding"))
    shifts = share_changes(judged_counts, stats).where(F.col("largest_shift") > shift_step).select(*LOAD, F.lit("shift").alias("finding"))
    return direct.unionByName(shifts)


