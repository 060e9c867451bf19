"""The attribute filter: conditions in disjunctive normal form as text, compiled to a Column.

"a gt 3 and b in x|y or udf()": alternatives are separated by " or ", conditions within one by " and ". A condition is
"name op value", "ordinal op type:value" (int, double, string) or "name(args)", a registered function of the frame.
Operators: gt ge lt le eq ne, and in, ni (not in) with values separated by | or a set's name as "set:NAME".
Values that cannot be parsed, and nulls, satisfy no condition but ni. The result is never null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.missing import is_blank, is_missing

FilterFunction = Callable[[DataFrame, Sequence[str]], Column]
COMPARE = {
    "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "eq": lambda c, v: c == v, "ne": lambda c, v: c != v,
}
TYPED = {"int": "long", "long": "long", "double": "double", "string": "string"}


def max_missing_fields(df: DataFrame, args: Sequence[str]) -> Column:
    """At most so many missing fields in the row."""
    return reduce(lambda a, b: a + b, [is_missing(F.col(f"`{c}`")).cast("int") for c in df.columns]) <= int(args[0])


def no_missing_field(df: DataFrame, args: Sequence[str]) -> Column:
    """None of the listed fields (all, if none is listed) is blank."""
    return reduce(lambda a, b: a & b, [~is_blank(F.col(f"`{_name(df, c)}`")) for c in (args or df.columns)])


FUNCTIONS: dict[str, FilterFunction] = {"maxMissingFields": max_missing_fields, "noMissingField": no_missing_field}


def _name(df: DataFrame, key: str) -> str:
    key = key.lstrip("$")
    return df.columns[int(key)] if key.isdigit() else key


def _condition(df: DataFrame, text: str, sets: Mapping[str, Sequence], functions: Mapping[str, FilterFunction]) -> Column:
    if call := re.fullmatch(r"\s*(\w+)\((.*)\)\s*", text):
        known = {**FUNCTIONS, **functions}
        if call[1] not in known:
            raise ValueError(f"no filter function {call[1]}")
        return known[call[1]](df, [a.strip() for a in call[2].split(",") if a.strip()])
    parts = text.split(None, 2)
    if len(parts) != 3:
        raise ValueError(f"a condition needs a field, an operator and a value: {text!r}")
    name, op, value = _name(df, parts[0]), parts[1], parts[2].strip()
    kind = df.schema[name].dataType
    c, cast = F.col(f"`{name}`"), None
    if (head := value.partition(":"))[0] in TYPED and head[1]:
        cast, value = TYPED[head[0]], head[2]
    elif isinstance(kind, T.IntegralType):
        cast = "long"
    elif isinstance(kind, T.FractionalType):
        cast = "double"
    else:
        cast = "string"
    parse = {"long": int, "double": float, "string": str}[cast]
    c = c.try_cast(cast)
    if op in ("in", "ni"):
        values = list(sets[value[4:]]) if value.startswith("set:") else [parse(v.strip()) for v in value.split("|")]
        inside = F.coalesce(c.isin(values), F.lit(False))
        return inside if op == "in" else ~inside
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(COMPARE[op](c, F.lit(parse(value))), F.lit(False))


def compile_filter(
    df: DataFrame,
    text: str,
    sets: Mapping[str, Sequence] | None = None,
    functions: Mapping[str, FilterFunction] | None = None,
    and_sep: str = " and ",
    or_sep: str = " or ",
) -> Column:
    """The filter's Column. Small named sets only; use ``relational.named_set_filter`` for sets that are tables."""
    either = [[_condition(df, c, sets or {}, functions or {}) for c in alternative.split(and_sep)] for alternative in text.split(or_sep)]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, conditions) for conditions in either])


def attr_filter(df: DataFrame, text: str, **options) -> DataFrame:
    return df.where(compile_filter(df, text, **options))
