"""The rule language: infix expressions as text, compiled to a Column.

    rule     := [ "if" ] or "then" or | or          an implication holds where its condition does not
    or, and  := terms joined by "or", "and"
    relation := sum [ ("<" "<=" ">" ">=" "=" "!=" or lt le gt ge eq ne) sum ]
    sum      := product { ("+" "-") product }       product := factor { ("*" "/") factor }
    factor   := number | 'text' | word | $name | "(" rule ")" | mean($x) | stdDev($x) | any registered function

"/" between whole numbers is whole division, truncated toward zero; division by zero and text that is no number give
null, and null satisfies no relation. A bare word is a string. Spaces are free; parentheses nest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<var>\$\w+)|(?P<str>'[^']*')|(?P<op><=|>=|!=|[<>=+\-*/(),])|(?P<word>[A-Za-z_][\w.]*))")
RELATION = {
    "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">=", "=": "=", "eq": "=", "!=": "!=", "ne": "!=",
}


@dataclass(frozen=True)
class Term:
    """A compiled part and whether it is a whole number, a number, text or a truth value."""

    column: Column
    kind: str


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, schema: T.StructType, functions: Mapping[str, Callable[..., Column]]):
        self.rest, self.schema, self.functions = tokens(text), schema, functions

    def peek(self) -> str:
        return self.rest[0][1] if self.rest else ""

    def take(self, *wanted: str) -> str:
        if not self.rest or (wanted and self.peek() not in wanted):
            raise ValueError(f"expected {' or '.join(wanted) or 'more'} before {self.peek()!r}")
        return self.rest.pop(0)[1]

    def rule(self) -> Term:
        conditional = self.peek() == "if"
        if conditional:
            self.take("if")
        first = self.either()
        if self.peek() == "then":
            self.take("then")
            then = self.either()
            return Term(~_truth(first) | _truth(then), "truth")
        if conditional:
            raise ValueError("if without then")
        return first

    def _joined(self, word: str, inner: Callable[[], Term], join) -> Term:
        out = inner()
        while self.peek() == word:
            self.take()
            out = Term(join(_truth(out), _truth(inner())), "truth")
        return out

    def either(self) -> Term:
        return self._joined("or", self.both, lambda a, b: a | b)

    def both(self) -> Term:
        return self._joined("and", self.relation, lambda a, b: a & b)

    def relation(self) -> Term:
        a = self.sum()
        if self.peek() not in RELATION:
            return a
        op, b = RELATION[self.take()], self.sum()
        x, y = a.column, b.column
        if {a.kind, b.kind} & {"whole", "number"}:
            x, y = (t.column if t.kind != "text" else t.column.try_cast("double") for t in (a, b))
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "!=": x != y}[op]
        return Term(F.coalesce(test, F.lit(False)), "truth")

    def sum(self) -> Term:
        out = self.product()
        while self.peek() in ("+", "-"):
            op, b = self.take(), self.product()
            x, y = _number(out), _number(b)
            out = Term(x + y if op == "+" else x - y, "whole" if out.kind == b.kind == "whole" else "number")
        return out

    def product(self) -> Term:
        out = self.factor()
        while self.peek() in ("*", "/"):
            op, b = self.take(), self.factor()
            x, y = _number(out), _number(b)
            whole = out.kind == b.kind == "whole"
            if op == "*":
                out = Term(x * y, "whole" if whole else "number")
            elif whole:
                out = Term(F.when(y != 0, F.call_function("div", x, F.when(y != 0, y))), "whole")
            else:
                out = Term(F.try_divide(x.cast("double"), y.cast("double")), "number")
        return out

    def factor(self) -> Term:
        if not self.rest:
            raise ValueError("the rule ends too early")
        group, t = self.rest.pop(0)
        if t == "-":
            inner = self.factor()
            return Term(-_number(inner), inner.kind)
        if t == "(":
            inner = self.rule()
            self.take(")")
            return inner
        if group == "num":
            return Term(F.lit(int(t)), "whole") if t.isdigit() else Term(F.lit(float(t)), "number")
        if group == "var":
            return self.variable(t[1:])
        if group == "str":
            return Term(F.lit(t[1:-1]), "text")
        if group == "word" and self.peek() == "(" and t in self.functions:
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.rest.pop(0)[1].lstrip("$") if self.rest[0][0] in ("var", "word") else self.factor().column)
                if self.peek() == ",":
                    self.take(",")
            self.take(")")
            return Term(self.functions[t](*args), "number")
        if group == "word":
            return Term(F.lit(t), "text")
        raise ValueError(f"unexpected {t!r}")

    def variable(self, name: str) -> Term:
        kind = self.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            return Term(F.col(f"`{name}`").cast("long"), "whole")
        if isinstance(kind, T.NumericType):
            return Term(F.col(f"`{name}`").cast("double"), "number")
        if isinstance(kind, T.BooleanType):
            return Term(F.col(f"`{name}`"), "truth")
        return Term(F.col(f"`{name}`").cast("string"), "text")


def _truth(t: Term) -> Column:
    if t.kind != "truth":
        raise ValueError("and, or, if and then need conditions")
    return F.coalesce(t.column, F.lit(False))


def _number(t: Term) -> Column:
    if t.kind == "truth":
        raise ValueError("arithmetic needs numbers")
    return t.column.try_cast("double") if t.kind == "text" else t.column


def compile_rule(text: str, schema: T.StructType, functions: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    parser = _Parser(text, schema, functions or {})
    out = parser.rule()
    if parser.rest:
        raise ValueError(f"unexpected {parser.peek()!r}")
    return out.column


def rule_filter(df: DataFrame, text: str, stats: DataFrame | None = None, keys: list[str] | None = None, project: list[str] | None = None) -> DataFrame:
    """Rows that satisfy the rule. mean($x) and stdDev($x) read ``stats`` (keys, attr, mean, std_dev), per key if there are any.

    Rows whose key has no statistics satisfy no relation with them.
    """
    keys, out, functions = keys or [], df, {}
    if stats is not None:
        used = sorted({m for m in re.findall(r"(?:mean|stdDev)\(\s*\$?(\w+)", text)})
        wide = stats.where(F.col("attr").isin(used)).groupBy(*keys).agg(
            *[F.max(F.when(F.col("attr") == a, F.col(c))).alias(f"_{c}_{a}") for a in used for c in ("mean", "std_dev")]
        )
        out = df.join(wide, keys, "left") if keys else df.join(F.broadcast(wide))  # one row without keys
        functions = {"mean": lambda a: F.col(f"_mean_{a}"), "stdDev": lambda a: F.col(f"_std_dev_{a}")}
    return out.where(compile_rule(text, out.schema, functions)).select(*(project or df.columns))
