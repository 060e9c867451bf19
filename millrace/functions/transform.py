"""Field transformers by tag, as Column builders, and the engine that chains them.

A builder takes the field's Column, its options and the row context and gives one Column or several; only the last
transformer of a chain may give several. Everything stays in the JVM. Values that cannot be read as the needed type give
null. Where the tag's contract is to fail, raise_error fails the query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Builder = Callable[..., "Column | list[Column]"]
TRANSFORMERS: dict[str, Builder] = {}
#: Milliseconds of the time units; months, quarters and years as mean lengths.
UNIT_MS = {
    "ms": 1, "sec": 1_000, "min": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 730 * 3_600_000, "quarter": 2_190 * 3_600_000, "year": 365 * 86_400_000,
}
CYCLE_MONTHS = {"month": 1, "quarter": 3, "semiAnnual": 6, "year": 12}


def transformer(*tags: str):
    def add(f: Builder) -> Builder:
        for t in tags:
            TRANSFORMERS[t] = f
        return f

    return add


def _plain(tag: str, f: Callable[[Column], Column]) -> None:
    TRANSFORMERS[tag] = lambda c, **_: f(c)


_plain("lowerCaseTrans", F.lower)
_plain("upperCaseTrans", F.upper)
_plain("trimTrans", F.trim)
_plain("nullTrans", lambda c: F.lit(None).cast("string"))


@transformer("upperCaseFirstTrans")
def upper_first(c: Column, keep_rest: bool = False, **_) -> Column:
    """The first letter in upper case; the rest is dropped unless ``keep_rest``."""
    first = F.upper(F.substring(c, 1, 1))
    return F.concat(first, F.substring(c, 2, 1_000_000_000)) if keep_rest else first


@transformer("patternBasedTrans")
def pattern_groups(c: Column, pattern: str, n: int, keep: bool = False, on_missing: str = "blank", **_) -> list[Column]:
    """The n groups of a pattern that must match as a whole; a missing group is blank or fails."""
    whole = f"^(?:{pattern})$"
    bad = F.raise_error(F.concat(F.lit("no match: "), F.coalesce(c, F.lit("null")))).cast("string")
    out = [F.when(c.rlike(whole), F.regexp_extract(c, whole, i + 1)).otherwise(bad) for i in range(n)]
    if on_missing == "fail":
        out = [F.when(x == "", F.raise_error(F.lit("missing group")).cast("string")).otherwise(x) for x in out]
    return [c, *out] if keep else out


@transformer("searchReplaceTrans")
def search_replace(c: Column, search: str, replace: str, first_only: bool = False, **_) -> Column:
    return F.regexp_replace(c, f"^(.*?)(?:{search})" if first_only else search, f"$1{replace}" if first_only else replace)


@transformer("patternBasedSearchReplaceTrans")
def mask_groups(c: Column, patterns: Sequence[str], mask: str = "*", **_) -> Column:
    """Under the first pattern that is found, its first group is masked at its length wherever it occurs."""
    out = c
    for p in reversed(list(patterns)):
        g = F.regexp_extract(c, p, 1)
        out = F.when(c.rlike(p) & (g != ""), F.replace(c, g, F.repeat(F.lit(mask), F.length(g)))).otherwise(out)
    return out


@transformer("keyValueTrans")
def key_value(c: Column, mapping: dict[str, str], keep: bool = False, **_) -> Column | list[Column]:
    """A small literal map; unknown keys stay as they are. Tables of keys are joined, see ``relational.lookup``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    value = F.coalesce(F.create_map(*pairs)[c], c)
    return [c, value] if keep else value


@transformer("defaultValueTrans")
def default_value(c: Column, default: str, **_) -> Column:
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(default)).otherwise(c)


@transformer("forcedReplaceTrans", "constGen")
def constant(c: Column | None = None, value: Any = None, **_) -> Column:
    return F.lit(value)


@transformer("anoynmizerTrans", "anonymizerTrans")
def anonymize(c: Column, mask: str = "*", **_) -> Column:
    return F.repeat(F.lit(mask), F.length(c))


@transformer("uniqueKeyGen")
def unique_key(c: Column | None = None, **_) -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


@transformer("groupTrans")
def group(c: Column, groups: dict[str, Sequence[str]], **_) -> list[Column]:
    """The value and the group that lists it; a value in no group fails."""
    found = F.raise_error(F.concat(F.lit("in no group: "), F.coalesce(c, F.lit("null")))).cast("string")
    for name, values in groups.items():
        found = F.when(c.isin(list(values)), F.lit(name)).otherwise(found)
    return [c, found]


@transformer("stringCustomTrans", "longCustomTrans", "doubleCustomTrans")
def custom(c: Column, script: str, columns: Sequence[Column] = (), params: dict[str, Any] | None = None, name: str = "field", **_) -> Column:
    """A SQL expression over the named field; other columns and :parameters may be used."""
    for k, v in (params or {}).items():
        script = script.replace(f":{k}", str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "\\'") + "'")
    return F.expr(script)


@transformer("stringDeleteTrans")
def delete(c: Column, **_) -> list[Column]:
    return []


@transformer("stringConcatenationTrans")
def concatenate(c: Column, text: str, delim: str = "", prepend: bool = False, **_) -> Column:
    parts = [F.lit(text), c] if prepend else [c, F.lit(text)]
    return F.concat(parts[0], F.lit(delim), parts[1])


@transformer("stringFieldMergeTrans")
def merge_fields(c: Column, fields: Sequence[str], delim: str = " ", **_) -> Column:
    return F.concat_ws(delim, c, *[F.col(f).cast("string") for f in fields])


@transformer("stringWithinFieldDelimTrans")
def within_field_delim(c: Column, start: int, n: int, width: int, delim: str = ",", out_delim: str = " ", **_) -> list[Column]:
    """A whole line cut at the delimiter, with n pieces from ``start`` collapsed to one where the line has too many."""
    parts = F.split(c, f"\\Q{delim}\\E", -1)
    extra = F.size(parts) - width
    out = []
    for i in range(width):
        broken = F.array_join(F.slice(parts, start + 1, F.greatest(extra, F.lit(0)) + 1), out_delim) if i == start else F.get(parts, F.lit(i) + F.when(F.lit(i > start), F.greatest(extra, F.lit(0))).otherwise(0))
        out.append(broken)
    return out


@transformer("stringSplitTrans")
def split_at(c: Column, delim: str, at: str = "first", keep: str = "both", **_) -> Column | list[Column]:
    """Cut at the first, the last or all delimiters. Without a delimiter the second part is empty."""
    if at == "all":
        return F.split(c, f"\\Q{delim}\\E", -1)
    if at == "first":
        a = F.substring_index(c, delim, 1)
        b = F.expr("''") if not delim else F.when(F.instr(c, delim) > 0, F.substring(c, F.instr(c, delim) + len(delim), F.length(c))).otherwise("")
    else:
        b0 = F.substring_index(c, delim, -1)
        has = F.instr(c, delim) > 0
        a = F.when(has, F.substring(c, F.lit(1), F.length(c) - F.length(b0) - len(delim))).otherwise(c)
        b = F.when(has, b0).otherwise("")
    return {"first": a, "second": b, "both": [a, b]}[keep]


@transformer("stringBinaryTrans")
def string_binary(c: Column, value: str, true: str, false: str, **_) -> Column:
    return F.when(c == value, F.lit(true)).otherwise(F.lit(false))


@transformer("categoricalBinaryTrans")
def one_hot(c: Column, cardinality: Sequence[str], **_) -> list[Column]:
    bad = F.raise_error(F.concat(F.lit("not in the cardinality: "), F.coalesce(c, F.lit("null")))).cast("int")
    known = F.coalesce(c.isin(list(cardinality)), F.lit(False))
    return [F.when(~known, bad).when(c == v, 1).otherwise(0) for v in cardinality]


@transformer("longPolynomialTrans")
def long_polynomial(c: Column, a: int, b: int, k: int, **_) -> Column:
    x = c.try_cast("long")
    return x * x * a + x * b + k


@transformer("doublePolynomialTrans")
def double_polynomial(c: Column, a: float, b: float, k: float, **_) -> Column:
    x = c.try_cast("double")
    return x * x * float(a) + x * float(b) + float(k)


@transformer("discretizerTrans")
def discretize(c: Column, width: float, **_) -> Column:
    """Bin number, truncated toward zero."""
    return (c.try_cast("double") / F.lit(float(width))).cast("int")


@transformer("binaryTrans")
def binary(c: Column, threshold: float, upper: Any = 1, lower: Any = 0, **_) -> Column:
    return F.when(c.try_cast("double") >= threshold, F.lit(upper)).otherwise(F.lit(lower))


def _arithmetic(kind: str, op: str) -> Builder:
    def build(c: Column, const: float, **_) -> Column:
        x, k = c.try_cast("long" if kind == "int" else "double"), F.lit(int(const) if kind == "int" else float(const))
        if op == "Divide":
            return F.call_function("div", x, k) if kind == "int" else x / k
        return {"Add": x + k, "Subtract": x - k, "Multiply": x * k}[op]

    return build


for _kind in ("int", "double"):
    for _op in ("Add", "Subtract", "Multiply", "Divide"):
        TRANSFORMERS[f"{_kind}{_op}Trans"] = _arithmetic(_kind, _op)


def _typed(x: Column, out: str) -> Column:
    return F.floor(x + 0.5).cast(out) if out in ("int", "long") else x.cast(out)


@transformer("binaryArithOperatorGen")
def two_fields(c: Column | None = None, left: str = "", right: str = "", op: str = "+", out: str = "double", **_) -> Column:
    a, b = F.col(left).try_cast("double"), F.col(right).try_cast("double")
    return _typed({"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op], out)


@transformer("binaryConstOperatorTrans")
def field_and_constant(c: Column, const: float, op: str, out: str = "double", **_) -> Column:
    a, b = c.try_cast("double"), F.lit(float(const))
    return _typed({"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op], out)


@transformer("intRoundOffTrans")
def round_off(c: Column, **_) -> Column:
    """Half up, also below zero."""
    return F.floor(c.try_cast("double") + 0.5).cast("long")


@transformer("floatRoundOffTrans")
def round_to(c: Column, precision: int = 3, **_) -> Column:
    return F.round(c.try_cast("double"), precision)


@transformer("mathFunction")
def math_function(c: Column, function: str, power: float = 2.0, slope: float = 1.0, **_) -> Column:
    x = c.try_cast("double")
    return {"log": lambda: F.log(x), "logTen": lambda: F.log10(x), "sqRoot": lambda: F.sqrt(x), "power": lambda: F.pow(x, F.lit(power)), "exp": lambda: F.exp(x), "sigmoid": lambda: 1 / (1 + F.exp(-slope * x))}[function]()


@transformer("epochTimeGen")
def epoch_now(c: Column | None = None, **_) -> Column:
    return F.unix_millis(F.current_timestamp())


@transformer("dateGen")
def date_now(c: Column | None = None, format: str = "yyyy-MM-dd HH:mm:ss", **_) -> Column:
    return F.date_format(F.current_timestamp(), format)


def parse_ms(c: Column, format: str | None, zone: str = "UTC") -> Column:
    """Epoch milliseconds from text of a format (in a zone), or from epoch ms where there is no format.

    Spark's own pattern letters apply; the session's zone is taken out, so the result does not depend on it.
    """
    if format is None or format == "epochMs":
        return c.try_cast("long")
    t = F.try_to_timestamp(c.cast("string"), F.lit(format))
    return F.unix_millis(F.to_utc_timestamp(F.from_utc_timestamp(t, F.current_timezone()), zone) if zone != "UTC" else F.from_utc_timestamp(t, F.current_timezone()))


def show_ms(ms: Column, format: str | None, zone: str = "UTC") -> Column:
    if format is None or format == "epochMs":
        return ms
    local = F.timestamp_millis(ms)
    return F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(local, zone), F.current_timezone()), format)


@transformer("dateFormatTrans")
def reformat_date(c: Column, source: str | None = None, target: str | None = None, source_zone: str = "UTC", target_zone: str = "UTC", **_) -> Column:
    return show_ms(parse_ms(c, source, source_zone), target, target_zone)


@transformer("elapsedTimeTrans", "contextualElapsedTimeTrans")
def elapsed(c: Column, unit: str, format: str | None = None, reference: str | None = None, reference_field: str | None = None, behind: str | None = None, zone: str = "UTC", **_) -> Column:
    """Rounded units from the reference (a date text, a field, or now) to the value; ``behind`` says what happens where
    the reference is not behind it: "zero" or "fail"."""
    t = parse_ms(c, format, zone)
    ref = parse_ms(F.col(reference_field), format, zone) if reference_field else parse_ms(F.lit(reference), format, zone) if reference else F.unix_millis(F.current_timestamp())
    out = F.floor((t - ref) / F.lit(UNIT_MS[unit]) + 0.5).cast("long")
    if behind == "zero":
        return F.when(t >= ref, out).otherwise(0)
    if behind == "fail":
        return F.when(t >= ref, out).otherwise(F.raise_error(F.lit("the reference is not behind")).cast("long"))
    return out


@transformer("timeCycleShiftTrans", "contextualTimeCycleShiftTrans")
def cycle_shift(c: Column, unit: str | None = None, reference: str | None = None, reference_field: str | None = None, unit_field: str | None = None, **_) -> Column:
    """A date moved on by whole months, quarters, half years or years until it is not before the reference."""
    d, ref = c.try_cast("date"), F.col(reference_field).try_cast("date") if reference_field else F.lit(reference).cast("date")
    if unit_field:
        step = F.lit(None).cast("int")
        for name, months in CYCLE_MONTHS.items():
            step = F.when(F.col(unit_field) == name, F.lit(months)).otherwise(step)
    else:
        step = F.lit(CYCLE_MONTHS[unit])
    between = (F.year(ref) - F.year(d)) * 12 + F.month(ref) - F.month(d)
    least = F.greatest(F.floor(between / step).cast("int"), F.lit(0))
    one = F.add_months(d, least * step)
    return F.when(d >= ref, d).when(one >= ref, one).otherwise(F.add_months(d, (least + 1) * step))


@transformer("dateComponentTrans")
def date_components(c: Column, components: Sequence[str], **_) -> list[Column]:
    """year, month, day, hour, minute, second, dayOfWeek (1 is Sunday), dayOfYear, quarter, or a format pattern."""
    t = c.cast("timestamp")
    known = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayOfWeek": F.dayofweek, "dayOfYear": F.dayofyear, "quarter": F.quarter}
    return [known[x](t) if x in known else F.date_format(t, x) for x in components]


CYCLES = {
    "hourOfDay": F.hour, "dayOfWeek": F.dayofweek, "dayOfMonth": F.dayofmonth, "monthOfYear": F.month, "quarterOfYear": F.quarter,
}


@transformer("timeCycleTrans", "multiTimeCycleTrans")
def time_cycle(c: Column, cycles: Sequence[str] | str, hour_granularity: int = 1, **_) -> Column | list[Column]:
    """hourOfDay (in steps of a divisor of 24), dayOfWeek (1 is Sunday), dayOfMonth, monthOfYear, quarterOfYear."""
    if 24 % hour_granularity:
        raise ValueError("the granularity must divide 24")
    names = [cycles] if isinstance(cycles, str) else list(cycles)
    t = c.cast("timestamp")
    out = [F.floor(F.hour(t) / hour_granularity).cast("int") if n == "hourOfDay" else CYCLES[n](t) for n in names]
    return out[0] if isinstance(cycles, str) else out


# Helpers that are functions of their own


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great circle distance on a sphere of radius 6371 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def logistic_scale(x: Column, middle: float, slope: float) -> Column:
    return 1 / (1 + F.exp(-slope * (x - middle)))


def exponential_scale(x: Column, rate: float) -> Column:
    return 1 - F.exp(-rate * x)


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation between points in rising order of x, constant beyond the ends."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def clean_tokens(c: Column, pattern: str = r"[^\p{L}\p{N}]+", stop_words: Sequence[str] = ()) -> Column:
    """Lower-case tokens between separators, without empty ones and stop words."""
    words = F.filter(F.split(F.lower(c), pattern), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def include_exclude(c: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Only the parts that match ``include``, then without those that match ``exclude``."""
    out = F.array_join(F.regexp_extract_all(c, F.lit(f"({include})"), F.lit(1)), " ") if include else c
    return F.regexp_replace(out, exclude, "") if exclude else out


def nth_part(c: Column, delim: str, n: int) -> Column:
    """The n-th part (from 0) between delimiters, null if there are fewer."""
    return F.get(F.split(c, f"\\Q{delim}\\E", -1), F.lit(n))


def digest(c: Column, kind: str = "md5") -> Column:
    return F.md5(c) if kind == "md5" else F.sha2(c, int(kind.removeprefix("sha")))


# The engine


@dataclass(frozen=True)
class Spec:
    """A chain on a field: (tag, options) each, and the names of its outputs."""

    field: str | None
    chain: Sequence[tuple[str, dict]] = ()
    outputs: Sequence[str] = field(default_factory=tuple)


def transform(df: DataFrame, specs: Sequence[Spec], custom_tags: dict[str, Builder] | None = None, keep_rest: bool = False) -> DataFrame:
    """One projection with all chains applied. Specs without a field are generators; ``keep_rest`` keeps other columns.

    Every chain must give as many Columns as it has outputs (default: the field's own name).
    """
    known, out = {**TRANSFORMERS, **(custom_tags or {})}, []
    for s in specs:
        columns: list[Column] = [F.col(s.field)] if s.field else []
        for i, (tag, options) in enumerate(s.chain):
            if i and len(columns) != 1:
                raise ValueError(f"only the last transformer of {s.field} may give several fields")
            got = known[tag](columns[0] if columns else None, **options)
            columns = got if isinstance(got, list) else [got]
        names = list(s.outputs) or ([s.field] if s.field and columns else [])
        if len(columns) != len(names):
            raise ValueError(f"{s.field}: {len(columns)} fields for {len(names)} outputs")
        out += [c.alias(n) for c, n in zip(columns, names, strict=True)]
    made = {n for s in specs for n in (s.outputs or [s.field])}
    used = {s.field for s in specs}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made | used] if keep_rest else []
    return df.select(*rest, *out)


