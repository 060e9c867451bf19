"""Delimited rows that fail to parse, apart from the sound rows, with the reason.

Lines are cut into cells in the JVM: a line with quotes is cut at its quotes, which gives the stretches outside and inside
of them in turn; each stretch outside is judged on its own (what may stand before an opening and after a closing quote),
commas inside are masked, and the line is put together again and cut at the commas that are left. No pattern has to look
through a whole line, so lines may be very long. Cells are exploded to (row, ordinal, value) and joined with the rule table,
each value is judged by its rule, and the failing cells are aggregated to one reason a row; rows whose quoting or cell
count is broken go along as one cell that fails. Sound rows are those without any failure (anti-join) and come out typed.

A null line is taken as an empty one. Cells are judged after outer blanks (spaces, tabs) are removed; empty cells are
judged like all others. Row ids must be unique; repeated lines under other ids are judged each. Blank: space or tab.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.common import broadcast_if_small

BLANKS = " \t"
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: Masks of a comma inside quotes, and of the mask's first character itself.
COMMA, ESCAPE = "\x01c", "\x01e"


def quoted_cells(line: Column, delim: str = ",") -> Column:
    """The cells of a line with quotes, or null if its quoting is broken. Inside quotes a doubled quote is one quote.

    Broken: a quote in an unquoted cell, an opening quote without a closing one, more than blanks after a closing quote.
    Cells keep the blanks around their quotes.
    """
    if delim in BLANKS and len(delim) == 1:
        blank = "[" + BLANKS.replace(delim, "") + "]*"
    else:
        blank = f"[{BLANKS}]*"
    d = re.escape(delim)
    masked = F.split(F.replace(line, F.lit("\x01"), F.lit(ESCAPE)), '"', -1)
    before, after, opens = f"(?s)(^|{d}){blank}\\z", f"(?s)^{blank}({d}|\\z)", f"(?s){d}{blank}\\z"

    def judged(bound: Column) -> Column:
        parts, last = bound["parts"], bound["last"]
        doubled = lambda x, i: (x == "") & (i > 0) & (i < last)

        def sound(x: Column, i: Column) -> Column:
            return (i % 2 == 1) | doubled(x, i) | (((i == 0) | x.rlike(after)) & ((i == last) | x.rlike(opens) | ((i == 0) & x.rlike(before))))

        def put(x: Column, i: Column) -> Column:
            return F.when(i % 2 == 1, F.replace(x, F.lit(delim), F.lit(COMMA))).when(doubled(x, i), F.lit('"')).otherwise(x)

        whole = F.split(F.array_join(F.transform(parts, put), ""), f"\\Q{delim}\\E", -1)
        cells = F.transform(whole, lambda c: F.replace(F.replace(c, F.lit(COMMA), F.lit(delim)), F.lit(ESCAPE), F.lit("\x01")))
        return F.when((last % 2 == 0) & F.forall(F.transform(parts, sound), lambda ok: ok), cells)

    # Bound as the one element of an array, so that the cuts are made once a line and not once a part.
    once = F.transform(F.array(masked), lambda p: F.struct(p.alias("parts"), (F.size(p) - 1).alias("last")))
    return F.get(F.transform(once, judged), F.lit(0))


def cells_of(df: DataFrame, line: str, delim: str = ",") -> DataFrame:
    """Adds _cells: array of raw cell texts, null where the quoting is broken."""
    text = F.coalesce(F.col(line), F.lit(""))
    plain = F.split(text, f"\\Q{delim}\\E", -1)
    return df.withColumn("_cells", F.when(F.contains(text, F.lit('"')), quoted_cells(text, delim)).otherwise(plain))


def _valid(v: Column) -> Column:
    """Whether a cell satisfies its rule; every check applies only where the rule has it. Never null."""
    kind = F.col("data_type")
    digits = F.regexp_replace(F.regexp_replace(v, r"^[+-]", ""), "^0+(?=.)", "")
    integer = F.when(v.rlike(INTEGER) & (F.length(digits) <= 10), v.try_cast("long"))
    decimal = F.when(v.rlike(DECIMAL), v.try_cast("double"))
    number = F.when(kind == "int", integer.cast("double")).when(kind == "double", decimal)
    day = F.when(v.rlike(ISO_DATE), F.try_to_date(v, "yyyy-MM-dd"))
    sound = [
        F.when(kind == "int", integer.between(-(2**31), 2**31 - 1)),
        F.when(kind == "double", decimal.isNotNull()),
        F.when(kind == "date", day.isNotNull() & F.coalesce(day >= F.to_date("earliest_date"), F.lit(True))),
        F.when(F.col("min_value").isNotNull(), number >= F.col("min_value")),
        F.when(F.col("max_value").isNotNull(), number <= F.col("max_value")),
        F.when(F.col("exact_length").isNotNull(), F.length(v) == F.col("exact_length")),
        F.when(F.col("members").isNotNull(), F.array_contains("members", v)),
        F.when(F.col("string_pattern").isNotNull() & ~F.col("external"), F.rlike(v, F.concat(F.lit("^(?:"), F.col("string_pattern"), F.lit(")\\z")))),
        F.when(F.col("external"), F.coalesce(F.col("known"), F.lit(False))),
    ]
    applies = [kind == "int", kind == "double", kind == "date", F.col("min_value").isNotNull(), F.col("max_value").isNotNull(), F.col("exact_length").isNotNull(), F.col("members").isNotNull(), F.col("string_pattern").isNotNull() & ~F.col("external"), F.col("external")]
    ok = F.lit(True)
    for a, s in zip(applies, sound, strict=True):
        ok = ok & (~F.coalesce(a, F.lit(False)) | F.coalesce(s, F.lit(False)))
    return ok


def failures(df: DataFrame, ident: str, line: str, rules: DataFrame, known: DataFrame, delim: str = ",") -> DataFrame:
    """ident, reason, columns: one row per faulty line, with the first reason that holds and the failing columns.

    ``rules``: ordinal_no, attr_name, data_type, earliest_date, min_value, max_value, exact_length, members,
    string_pattern, validators. ``known``: attr_name, value: the values an attribute with the validator
    membershipExtSrc may take (an equi-join; broadcast only after a check of its size).
    """
    rules = broadcast_if_small(rules.withColumn("external", F.array_contains(F.coalesce("validators", F.array().cast("array<string>")), "membershipExtSrc")), 10_000)
    width = rules.agg(F.count("*")).collect()[0][0]
    rows = cells_of(df.select(F.col(ident).alias("_id"), F.col(line).alias("_line")), "_line", delim).select("_id", "_cells")
    broken = F.when(F.col("_cells").isNull(), "quoting").when(F.size("_cells") != width, "column_count")
    rows = rows.select("_id", broken.alias("_broken"), "_cells")
    # A broken line has no cells and comes out once, without a rule.
    cells = rows.select("_id", "_broken", F.posexplode_outer(F.when(F.col("_broken").isNull(), F.col("_cells"))).alias("ordinal_no", "value"))
    cells = cells.withColumn("value", F.btrim("value", F.lit(BLANKS))).join(rules, "ordinal_no", "left")
    listed = broadcast_if_small(known.select(F.col("attr_name"), F.col("value"), F.lit(True).alias("known")).distinct())
    bad = cells.join(listed, ["attr_name", "value"], "left").where(F.col("_broken").isNotNull() | ~_valid(F.col("value")))
    bad = bad.groupBy("_id").agg(F.coalesce(F.max("_broken"), F.lit("invalid_value")).alias("reason"), F.array_sort(F.collect_set("attr_name")).alias("columns"))
    return bad.withColumnRenamed("_id", ident)


def sound_rows(df: DataFrame, ident: str, line: str, rules: DataFrame, known: DataFrame, delim: str = ",") -> DataFrame:
    """The sound rows typed by the rules: ident and one column per rule (a rule name that clashes with ident gets _)."""
    faulty = failures(df, ident, line, rules, known, delim)
    kinds = {"int": "int", "long": "long", "double": "double", "date": "date"}
    rows = cells_of(df.select(F.col(ident).alias("_id"), F.col(line).alias("_line")), "_line", delim).join(faulty.select(F.col(ident).alias("_id")), "_id", "left_anti")
    typed = []
    for r in sorted(rules.select("ordinal_no", "attr_name", "data_type").collect(), key=lambda r: r[0]):
        name = r["attr_name"] + "_" * (r["attr_name"] == ident)
        typed.append(F.btrim(F.get("_cells", F.lit(r["ordinal_no"])), F.lit(BLANKS)).try_cast(kinds.get(r["data_type"], "string")).alias(name))
    return rows.select(F.col("_id").alias(ident), *typed)
