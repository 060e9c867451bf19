"""Profiling counters: distinct values, composite keys, values, patterns, tokens, dependencies, missing fields, types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.missing import is_missing
from millrace.functions.validators import PATTERNS, UPPER_CASED
from millrace.operators.stats import unpivot


def unique_values(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), ignore_case: bool = False) -> DataFrame:
    """keys, attr, value: the distinct non-null values, one row each (a set of any size stays distributed)."""
    x = unpivot(df, attrs, keys, "string").where("value is not null")
    x = x.withColumn("value", F.lower("value")) if ignore_case else x
    return x.distinct()


def unique_count(df: DataFrame, attrs: Sequence[str], keys: Sequence[str] = (), cardinality: Mapping[str, int] | None = None, kind: str = "string", ignore_case: bool = False) -> DataFrame:
    """keys, attr, unique_values [, completeness: distinct over cardinality]; values compared as ``kind`` (unreadable ones left out)."""
    x = unpivot(df, attrs, keys, "string")
    v = F.lower("value") if ignore_case else F.col("value") if kind == "string" else F.col("value").try_cast(kind)
    x = x.withColumn("value", v).where("value is not null").distinct().groupBy(*keys, "attr").agg(F.count("*").alias("unique_values"))
    if not cardinality:
        return x
    sizes = F.create_map(*[F.lit(v) for kv in cardinality.items() for v in kv])
    return x.withColumn("completeness", F.col("unique_values") / sizes[F.col("attr")])


def composite_count(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.groupBy(*fields).agg(F.count("*").alias("count"))


def unique_key_violations(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Composite keys that occur more than once."""
    return composite_count(df, fields).where("count > 1")


def value_count(df: DataFrame, values: Mapping[str, Sequence[str]], ignore_case: bool = False) -> DataFrame:
    """attr, value, count of the listed values."""
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    x = unpivot(df, list(values), (), "string").withColumn("value", fold(F.col("value")))
    wanted = reduce(lambda a, b: a | b, [(F.col("attr") == a) & F.col("value").isin([v.lower() if ignore_case else v for v in vs]) for a, vs in values.items()])
    return x.where(wanted).groupBy("attr", "value").agg(F.count("*").alias("count"))


def pattern_count(df: DataFrame, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """attr, pattern, count of the values that match it as a whole. One pass, one row of sums."""
    pairs = [(a, p) for a, ps in patterns.items() for p in ps]
    sums = df.agg(*[F.coalesce(F.sum(F.col(a).cast("string").rlike(f"^(?:{p})$").cast("long")), F.lit(0)).alias(f"_{i}") for i, (a, p) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(p).alias("pattern"), F.col(f"_{i}").alias("count")) for i, (a, p) in enumerate(pairs)])))


def token_count(df: DataFrame, text: str, delim: str = r"\s+", position: bool = False, min_count: int | None = None) -> DataFrame:
    """token [, position], count of the non-empty tokens; more often than ``min_count`` only."""
    x = df.select(F.posexplode(F.split(text, delim)).alias("position", "token")).where("token <> ''")
    x = x.groupBy("token", *(["position"] if position else [])).agg(F.count("*").alias("count"))
    return x if min_count is None else x.where(F.col("count") > min_count)


def functional_dependency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """source, target, source_value, target_values: distinct targets per source value; the dependency holds if all are 1."""
    cells = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(a).cast("string").alias("source_value"), F.col(b).cast("string").alias("_t")) for a, b in pairs])
    x = df.select(F.inline(cells)).where("_t is not null").distinct()
    return x.groupBy("source", "target", "source_value").agg(F.count("*").alias("target_values"))


def missing_counts(df: DataFrame, how: str = "col", key: str | None = None, tag: str | None = None) -> DataFrame:
    """row: key and missing fields of rows with any; col: missing values per column; distr: rows per number of missing fields."""
    flags = {c: is_missing(F.col(f"`{c}`"), tag).cast("long") for c in df.columns if c != key}
    if how == "col":
        s = df.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(c) for c, v in flags.items()])
        return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").alias("missing")) for c in flags])))
    n = reduce(lambda a, b: a + b, flags.values())
    if how == "row":
        return df.select(key, n.alias("missing")).where("missing > 0")
    return df.select(n.alias("missing")).groupBy("missing").agg(F.count("*").alias("rows"))


# Type inference


@dataclass(frozen=True)
class TypeRule:
    """A type, its strength, and the condition that a value has it."""

    name: str
    strength: int
    test: object
    numeric: bool = False


def pattern_rule(name: str, pattern: str, strength: int, length: int | None = None) -> TypeRule:
    """A custom string type: a pattern the whole value must match, and perhaps a length."""
    return TypeRule(name, strength, lambda v: v.rlike(f"^(?:{pattern})$") & (F.lit(True) if length is None else F.length(v) == length))


def int_range_rule(name: str, lo: int, hi: int, strength: int) -> TypeRule:
    """A custom whole-number type with a range."""
    return TypeRule(name, strength, lambda v: _whole(v) & v.try_cast("long").between(lo, hi), True)


def _whole(v: Column) -> Column:
    return v.rlike(r"^[+-]?\d{1,18}$")


#: Strengths of the types.
STRENGTH = {
    "numericBoolean": 95, "age": 90, "currency": 90, "monetaryAmount": 89, "state": 85, "date": 84, "SSN": 80, "phoneNumber": 80, "zip": 80, "epochTime": 80, "id": 78, "streetAddress": 75, "city": 70, "int": 20,
    "float": 10,
}


def standard_rules(date_formats: Sequence[str] = ("yyyy-MM-dd",), id_lengths: Sequence[int] = (), epoch_since_ms: int = 946_684_800_000) -> list[TypeRule]:
    """The built-in types: numbers (int, float, numericBoolean, age, epochTime) and strings by pattern, strongest first."""
    named = lambda n: (lambda v: (F.upper(v) if n in UPPER_CASED else v).rlike(PATTERNS[n]))
    rules = [TypeRule(n, STRENGTH[n], named(n)) for n in ("currency", "state", "SSN", "phoneNumber", "zip", "streetAddress", "city")]
    money = PATTERNS["currency"].strip("^$")
    rules.append(TypeRule("monetaryAmount", STRENGTH["monetaryAmount"], lambda v: v.rlike(f"^{money}\\s+\\d+(\\.\\d+)?$")))
    rules.append(TypeRule("date", STRENGTH["date"], lambda v: reduce(lambda a, b: a | b, [F.try_to_timestamp(v, F.lit(f)).isNotNull() for f in date_formats])))
    rules += [TypeRule(f"id{n}", STRENGTH["id"], lambda v, n=n: v.rlike(PATTERNS["id"]) & (F.length(v) == n)) for n in id_lengths]
    rules += [
        TypeRule("numericBoolean", STRENGTH["numericBoolean"], lambda v: _whole(v) & v.try_cast("long").between(-1, 1), True),
        TypeRule("age", STRENGTH["age"], lambda v: _whole(v) & v.try_cast("long").between(0, 100), True),
        TypeRule("epochTime", STRENGTH["epochTime"], lambda v: _whole(v) & (v.try_cast("long") >= epoch_since_ms), True),
        TypeRule("int", STRENGTH["int"], _whole, True),
        TypeRule("float", STRENGTH["float"], lambda v: v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), True),
    ]
    return rules


def type_counts(df: DataFrame, attrs: Sequence[str], rules: Sequence[TypeRule]) -> DataFrame:
    """attr, values (not missing), distinct_values, and a count per rule: two aggregations over the unpivoted cells."""
    cells = unpivot(df, attrs, (), "string").where("value is not null and trim(value) <> ''").withColumn("value", F.trim("value"))
    counted = cells.groupBy("attr", "value").agg(F.count("*").alias("n"))  # each distinct value is tested once
    tests = [F.sum(F.when(F.coalesce(r.test(F.col("value")), F.lit(False)), F.col("n")).otherwise(0)).alias(r.name) for r in rules]
    return counted.groupBy("attr").agg(F.sum("n").alias("values"), F.count("*").alias("distinct_values"), *tests)


def infer_types(df: DataFrame, attrs: Sequence[str], rules: Sequence[TypeRule] | None = None, threshold: int = 90, max_categories: int = 10) -> DataFrame:
    """attr, data_type, matched, ambiguous.

    Numeric types compete if all values are numbers (int or float): the strongest that all values match, numericBoolean
    only with two distinct values at most. Otherwise the strongest string type matched by ``threshold`` percent or more;
    it is ambiguous below 100 percent. Else string, or categorical with at most ``max_categories`` distinct values.
    """
    rules = list(rules or standard_rules())
    c, n = type_counts(df, attrs, rules), F.col("values")
    order = sorted(rules, key=lambda r: -r.strength)
    kind, matched = F.when(F.col("distinct_values") <= max_categories, "categorical").otherwise("string"), F.col("values")
    for r in reversed([r for r in order if not r.numeric]):
        hit = F.col(r.name) * 100 >= n * threshold
        kind, matched = F.when(hit, r.name).otherwise(kind), F.when(hit, F.col(r.name)).otherwise(matched)
    numeric = F.col("float") + F.lit(0) == n
    for r in reversed([r for r in order if r.numeric]):
        hit = numeric & (F.col(r.name) == n)
        if r.name == "numericBoolean":
            hit = hit & (F.col("distinct_values") <= 2)
        kind, matched = F.when(hit, r.name).otherwise(kind), F.when(hit, F.col(r.name)).otherwise(matched)
    return c.select("attr", kind.alias("data_type"), matched.cast("long").alias("matched"), (matched < n).alias("ambiguous"))


