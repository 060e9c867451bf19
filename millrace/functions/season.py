"""Season cycles: the index of a point in time within a repeating cycle, as a Column.

All work on epoch seconds shifted by whole hours; an index below 0 means "not in the cycle". Days and weeks count from
the epoch, whose first day was a Thursday: by default a week starts on Thursday, as do "weekdays" (days 0 to 4);
``aligned=True`` makes weeks start on Monday.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, WEEK = 86_400, 604_800
#: Widths in seconds of the parts of a day.
PARTS = {"quarterHour": 900, "halfHour": 1_800, "hour": 3_600, "sixHour": 21_600, "twelveHour": 43_200}


def _floor(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("long")


def _group(value: Column, groups: dict[int, int]) -> Column:
    """The group of a value, -1 outside all groups."""
    out = F.lit(-1).cast("long")
    for v, g in groups.items():
        out = F.when(value == v, F.lit(g).cast("long")).otherwise(out)
    return out


def ranges(groups: Sequence[tuple[int, int]]) -> dict[int, int]:
    """{value: group number} of inclusive ranges."""
    return {v: g for g, (lo, hi) in enumerate(groups) for v in range(lo, hi + 1)}


def season_index(
    seconds: Column,
    cycle: str,
    *,
    shift_hours: int = 0,
    groups: Sequence[tuple[int, int]] = (),
    days: Sequence[str] = (),
    spans: Sequence[tuple[int, int]] = (),
    aligned: bool = False,
) -> Column:
    """The cycle's index at ``seconds`` (epoch). ``groups``: inclusive hour, day or month ranges; ``days``: holidays or
    listed days (yyyy-MM-dd); ``spans``: inclusive [from, to] epoch seconds for anyTimeRange."""
    s = seconds.cast("long") + shift_hours * 3_600
    in_week = s + 3 * DAY if aligned else s
    day_of_week = F.floor(F.pmod(in_week, F.lit(WEEK)) / DAY).cast("long")
    in_day, no = F.pmod(s, F.lit(DAY)), F.lit(-1).cast("long")
    weekday, hour = day_of_week < 5, F.floor(F.pmod(s, F.lit(DAY)) / 3_600).cast("long")
    date = F.date_add(F.lit("1970-01-01").cast("date"), _floor(s, DAY).cast("int"))
    holiday = date.isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False)
    simple = {
        "noCycle": lambda: F.lit(0).cast("long"),
        "dayOfWeek": lambda: day_of_week,
        "weekDayOfWeek": lambda: F.when(weekday, day_of_week).otherwise(no),
        "weekEndDayOfWeek": lambda: F.when(~weekday, day_of_week).otherwise(no),
        "weekDayOrWeekendOfWeek": lambda: F.when(weekday, 0).otherwise(1).cast("long"),
        "dayHolidayOfWeek": lambda: F.when(holiday, F.lit(7).cast("long")).otherwise(day_of_week),
        "weekDayHolidayOfWeek": lambda: F.when(holiday, F.lit(5).cast("long")).when(weekday, day_of_week).otherwise(no),
        "weekDayHolidayOrWeekendOfWeek": lambda: F.when(holiday | ~weekday, 1).otherwise(0).cast("long"),
        "hourRangeOfDay": lambda: _group(hour, ranges(groups)),
        "hourRangeOfWeekDay": lambda: F.when(weekday, _group(hour, ranges(groups))).otherwise(no),
        "hourRangeOfWeekEndDay": lambda: F.when(~weekday, _group(hour, ranges(groups))).otherwise(no),
        "dayRangeOfWeek": lambda: _group(day_of_week, ranges(groups)),
        "monthRangeOfYear": lambda: _group(F.month(date) - 1, ranges(groups)),
        "nightDayHourOfDay": lambda: F.when((hour >= groups[0][0]) & (hour < groups[0][1]), 1).otherwise(0).cast("long"),
        "monthOfYear": lambda: (F.month(date) - 1).cast("long"),
        "weekOfYear": lambda: F.floor((F.dayofyear(date) - 1) / 7).cast("long"),
        "anyDay": lambda: _first([date == F.lit(d).cast("date") for d in days]),
        "anyTimeRange": lambda: _first([s.between(lo, hi) for lo, hi in spans]),
    }
    if cycle in simple:
        return simple[cycle]()
    for name, width in PARTS.items():
        index = F.floor(in_day / width).cast("long")
        if cycle == f"{name}OfDay":
            return index
        if cycle == f"{name}OfWeekDay":
            return F.when(weekday, index).otherwise(no)
        if cycle == f"{name}OfWeekEndDay":
            return F.when(~weekday, index).otherwise(no)
    raise ValueError(f"unknown cycle {cycle}")


def _first(tests: list[Column]) -> Column:
    out = F.lit(-1).cast("long")
    for i, t in reversed(list(enumerate(tests))):
        out = F.when(t, F.lit(i).cast("long")).otherwise(out)
    return out


def parent_index(seconds: Column, cycle: str, shift_hours: int = 0, aligned: bool = False) -> Column:
    """The number of the cycle itself: weeks for cycles of a week, days for cycles of a day, years for those of a year."""
    s = seconds.cast("long") + shift_hours * 3_600
    date = F.date_add(F.lit("1970-01-01").cast("date"), _floor(s, DAY).cast("int"))
    if cycle.endswith(("OfDay", "OfWeekDay", "OfWeekEndDay")):
        return _floor(s, DAY)
    if cycle.endswith("OfYear"):
        return F.year(date).cast("long")
    if cycle.endswith("OfWeek"):
        return _floor(s + 3 * DAY if aligned else s, WEEK)
    return F.lit(0).cast("long")


def first_cycle(seconds: Column, cycles: Sequence[dict]) -> tuple[Column, Column]:
    """(type, index) of the first of several cycles with an index of 0 or more; ("normal", 0) where there is none."""
    kind, index = F.lit("normal"), F.lit(0).cast("long")
    for c in reversed(cycles):
        i = season_index(seconds, **c)
        kind, index = F.when(i >= 0, F.lit(c["cycle"])).otherwise(kind), F.when(i >= 0, i).otherwise(index)
    return kind, index
