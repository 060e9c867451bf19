"""Validators by tag, as conditions that hold for valid values, and the engine that tags, splits and scores rows.

A condition is never null: what cannot be read as the needed type is invalid. All conditions of a row are evaluated in
one projection; the failed tags of a field are an array<string>.
"""

from __future__ import annotations

import queue
import subprocess
import threading
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.missing import is_missing
from millrace.operators.common import broadcast_if_small

#: The named patterns.
PATTERNS = {
    "name": r"^([A-Z]{1}[a-z]{1,20}(\s{1,4}[A-Z]{1}[a-z]{0,20}){1,4})$",
    "SSN": r"^(\d{3}( |-)?\d{2}( |-)?\d{4}|\w{3}( |-)?\w{2}( |-)?(\w){4})$",
    "phoneNumber": r"^(\(?\d{3}\)?[ \.-]?\d{3}[ \.-]?\d{4})$",
    "streetAddress": r"^(\d{1,8}(\s{1,4}\S{1,20})+)$",
    "city": r"^([A-Za-z]{2,20}(\s{1,4}[A-Za-z]{2,20})*)$",
    "zip": r"^(\d{5}([-\s]\d{4})?)$",
    "state": r"^(AK|AL|AR|AZ|CA|CO|CT|DE|FL|GA|HI|IA|ID|IL|IN|KS|KY|LA|MA|MD|ME|MI|MN|MO|MS|MT|NC|ND|NE|NH|NJ|NM|NV|NY|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VA|VT|WA|WI|WV|WY)$",
    "currency": r"^(AUD|BRL|CAD|DKK|EUR|HKD|INR|NOK|FKP|RUB|SGD|CHF|JPY|USD)$",
    "boolean": r"^(TRUE|FALSE|T|F|YES|NO|Y|N)$",
    "id": r"^([a-zA-Z0-9-]{1,40})$",
}
UPPER_CASED = ("state", "currency", "boolean")


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def full_match(c: Column, pattern: str) -> Column:
    return holds(c.cast("string").rlike(f"^(?:{pattern})$"))


def named_pattern(c: Column, name: str) -> Column:
    text = c.cast("string")
    return full_match(F.upper(text) if name in UPPER_CASED else text, PATTERNS[name])


def as_date(c: Column, format: str | None) -> Column:
    """A timestamp from text of a format, or from epoch seconds (10 digits or more) or milliseconds (13 or more)."""
    if format in ("epochMs", "epochSec"):
        n = c.try_cast("long")
        return F.timestamp_millis(n if format == "epochMs" else n * 1000)
    return F.try_to_timestamp(c.cast("string"), F.lit(format)) if format else c.cast("timestamp")


def _bound(kind: str, low: bool):
    def check(c: Column, value, **o) -> Column:
        if kind == "date":
            t, limit = as_date(c, o.get("format")), F.lit(value).cast("timestamp")
            return holds(t > limit if low else t < limit)
        x = c.try_cast({"int": "long", "double": "double", "string": "string"}[kind])
        return holds(x >= value if low else x <= value)

    return check


def _length(compare: str):
    def check(c: Column, value: int, **_) -> Column:
        n = F.length(F.coalesce(c.cast("string"), F.lit("")))
        return {"min": n >= value, "max": n <= value, "exact": n == value}[compare]

    return check


def ensure_date(c: Column, format: str | None = None, **_) -> Column:
    if format in ("epochMs", "epochSec"):
        return full_match(c, r"\d{13,}" if format == "epochMs" else r"\d{10,}")
    return as_date(c, format).isNotNull()


VALIDATORS: dict[str, Callable[..., Column]] = {
    "minInt": _bound("int", True), "maxInt": _bound("int", False), "minDouble": _bound("double", True), "maxDouble": _bound("double", False), "minString": _bound("string", True),
    "maxString": _bound("string", False), "minDate": _bound("date", True), "maxDate": _bound("date", False), "minLength": _length("min"), "maxLength": _length("max"), "exactLength": _length("exact"),
    "notMissing": lambda c, tag=None, **_: ~is_missing(c, tag),
    "pattern": lambda c, value, **_: full_match(c, value),
    "preDefinedPattern": lambda c, value, **_: named_pattern(c, value),
    "membership": lambda c, value, **_: holds(c.cast("string").isin([str(v) for v in value])),
    "ensureInt": lambda c, **_: full_match(c, r"\s*[+-]?\d+\s*") & c.try_cast("int").isNotNull(),
    "ensureLong": lambda c, **_: full_match(c, r"\s*[+-]?\d+\s*") & c.try_cast("long").isNotNull(),
    "ensureDouble": lambda c, **_: c.try_cast("double").isNotNull(),
    "ensureDate": ensure_date,
    "zscoreBasedRange": lambda c, mean, std_dev, max_z, **_: holds(F.abs(c.try_cast("double") - mean) <= std_dev * max_z),
    "robustZscoreBasedRange": lambda c, median, deviation, max_z, **_: holds(F.abs(c.try_cast("double") - median) <= deviation * max_z),
}


# Row validators


def not_missing_group(groups: Sequence[Sequence[str]], tag: str | None = None) -> Column:
    """At least one field of every group is there."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [~is_missing(F.col(c), tag) for c in g]) for g in groups])


def value_dependency(source: str, target: str, allowed: dict[str, Sequence[str] | str]) -> Column:
    """Per source value the allowed target values; "" asks for an empty target, "*" for any that is not. Others are free."""
    out, t = F.lit(True), F.col(target)
    for value, rule in allowed.items():
        ok = is_missing(t) if rule == "" else ~is_missing(t) if rule == "*" else holds(t.isin(list(rule)))
        out = F.when(F.col(source) == value, ok).otherwise(out)
    return out


# The engine


@dataclass(frozen=True)
class Check:
    field: str
    tag: str
    options: dict


class Validated(NamedTuple):
    valid: DataFrame
    invalid: DataFrame
    tagged: DataFrame


def failed_tags(checks: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(tag)) for tag, ok in checks])) if checks else F.array().cast("array<string>")


def tag_rows(df: DataFrame, checks: Sequence[Check], row_checks: dict[str, Column] | None = None, custom: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """The rows with <field>_failed per checked field, row_failed, and valid. One projection."""
    known = {**VALIDATORS, **(custom or {})}
    fields = list(dict.fromkeys(c.field for c in checks))
    failed = {f: failed_tags([(c.tag, known[c.tag](F.col(f"`{f}`"), **c.options)) for c in checks if c.field == f]) for f in fields}
    out = df.select("*", *[v.alias(f"{f}_failed") for f, v in failed.items()], failed_tags(list((row_checks or {}).items())).alias("row_failed"))
    none = [F.size(f"{f}_failed") == 0 for f in fields] + [F.size("row_failed") == 0]
    return out.withColumn("valid", reduce(lambda a, b: a & b, none))


def validate(df: DataFrame, checks: Sequence[Check], row_checks: dict[str, Column] | None = None, custom=None, mask: str | None = None) -> Validated:
    """Valid rows as they came, invalid rows with their tags (or failing fields masked), and all rows tagged."""
    tagged = tag_rows(df, checks, row_checks, custom)
    valid = tagged.where("valid").select(*[f"`{c}`" for c in df.columns])
    invalid = tagged.where("not valid").drop("valid")
    if mask is not None:
        fields = {c.field for c in checks}
        shown = [F.when(F.size(f"{c}_failed") > 0, F.lit(mask)).otherwise(F.col(f"`{c}`").cast("string")).alias(c) if c in fields else F.col(f"`{c}`") for c in df.columns]
        invalid = invalid.select(*shown, "row_failed")
    return Validated(valid, invalid, tagged)


def validity_metric(tagged: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds valid_fields and validity: the weighted share of fields without failures."""
    ok = {f: (F.size(f"{f}_failed") == 0).cast("int") for f in weights}
    count = reduce(lambda a, b: a + b, ok.values())
    score = reduce(lambda a, b: a + b, [ok[f] * w for f, w in weights.items()]) / sum(weights.values())
    return tagged.withColumn("valid_fields", count).withColumn("validity", score)


def piped(df: DataFrame, columns: Sequence[str], command: Sequence[str], flag: str = "valid", delim: str = ",") -> DataFrame:
    """Adds ``flag``: what an outside program says of each row.

    One process a task: it gets a line per row with the named fields (null as empty; line breaks and the delimiter in a
    field as blanks) and answers each with a line, true or false in any case; any other answer is null. A program that
    fails, or gives another number of lines, fails the task. ``command`` is trusted input.
    """
    names, words = list(columns), list(command)
    schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])
    at = [df.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = subprocess.Popen(words, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8", bufsize=1 << 16)

        def feed(lines: list[str]) -> None:
            p.stdin.write("".join(lines))
            p.stdin.flush()

        waiting: deque = deque()
        todo, answers = queue.Queue(maxsize=4), queue.Queue()

        def write() -> None:
            gone = False
            while (lines := todo.get()) is not None:
                try:
                    if not gone:
                        feed(lines)
                except BrokenPipeError:
                    gone = True  # what it has not read is told by the missing answers
            try:
                p.stdin.close()
            except BrokenPipeError:
                pass

        def read() -> None:
            for line in p.stdout:
                answers.put(line.strip().lower())
            answers.put(None)

        threads = [threading.Thread(target=f, daemon=True) for f in (write, read)]
        for t in threads:
            t.start()

        def answered(b: pa.RecordBatch) -> pa.RecordBatch:
            said = []
            for _ in range(b.num_rows):
                x = answers.get()
                if x is None:
                    raise RuntimeError(f"{words[0]} gave too few answers")
                said.append({"true": True, "false": False}.get(x))
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.bool_())], names=[*b.schema.names, flag])

        clean = str.maketrans({"\n": " ", "\r": " ", delim: " "})
        for b in batches:
            fields = [[("" if v is None else str(v)).translate(clean) for v in b.column(i).to_pylist()] for i in at]
            todo.put([delim.join(r) + "\n" for r in zip(*fields, strict=True)])
            waiting.append(b)
            while len(waiting) > 4:
                yield answered(waiting.popleft())
        todo.put(None)
        while waiting:
            yield answered(waiting.popleft())
        if answers.get() is not None or p.wait() != 0:
            raise RuntimeError(f"{words[0]} failed or gave too many answers")

    return df.mapInArrow(run, schema)


def external_membership(df: DataFrame, field: str, source: DataFrame, key: str, flag: str = "known") -> DataFrame:
    """Adds whether the field's value is among the source's keys: an equi-join, broadcast only if the keys are few."""
    keys = broadcast_if_small(source.select(F.col(key).cast("string").alias("_key")).where("_key is not null").distinct().withColumn(flag, F.lit(True)))
    return df.join(keys, df[field].cast("string") == keys["_key"], "left").drop("_key").withColumn(flag, F.coalesce(flag, F.lit(False)))


SIMPLE = {"int": "ensureInt", "long": "ensureLong", "double": "ensureDouble", "float": "ensureDouble", "date": "ensureDate"}


def simple_validate(df: DataFrame, types: dict[str, str], date_format: str | None = None, sample: float | None = None, seed: int = 100, missing_only: bool = False) -> Validated:
    """Each field by its declared type only (or, with ``missing_only``, that it is there). ``sample``: a share of the rows."""
    rows = df if sample is None else df.sample(False, sample, seed)
    checks = [Check(f, "notMissing", {}) for f in types] if missing_only else [Check(f, SIMPLE[t], {"format": date_format} if t == "date" else {}) for f, t in types.items() if t in SIMPLE]
    return validate(rows, checks)


def outlier_validate(df: DataFrame, stats: DataFrame, keys: list[str], attrs: list[str], max_z: float | None = None, chebyshev_p: float | None = None, min_count: int = 2, output: str = "invalid") -> DataFrame:
    """Rows by whether every attribute lies within mean +- m * std_dev of its key; m is max_z or sqrt(1 / p).

    ``stats``: keys, attr, mean, std_dev, count. An attribute without statistics, or with fewer than ``min_count``, is valid.
    """
    m = max_z if max_z is not None else (1 / chebyshev_p) ** 0.5
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("attr") == a, F.struct("mean", "std_dev", "count"))).alias(f"_{a}") for a in attrs])
    x = df.join(wide, keys, "left")
    bad = [holds((F.col(f"_{a}.count") >= min_count) & (F.abs(F.col(a) - F.col(f"_{a}.mean")) > m * F.col(f"_{a}.std_dev"))) for a in attrs]
    x = x.withColumn("valid", ~reduce(lambda a, b: a | b, bad)).drop(*[f"_{a}" for a in attrs])
    return {"invalid": x.where("not valid").drop("valid"), "valid": x.where("valid").drop("valid"), "all": x}[output]
