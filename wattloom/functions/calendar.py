"""Market-calendar expressions on zone-free timestamps (session zone pinned to UTC)."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def from_micros(x: Column) -> Column:
    return F.timestamp_micros(x).cast("timestamp_ntz")


def floor_time(t: Column, seconds: int) -> Column:
    step = seconds * 1_000_000
    return from_micros(F.floor(micros(t) / step) * step)


def interval_ceiling(t: Column, seconds: int = 1800) -> Column:
    """End of the interval (start, end] holding t; an exact boundary stays."""
    step = seconds * 1_000_000
    return from_micros(F.ceil(micros(t) / step) * step)


def month_start(t: Column) -> Column:
    return F.date_trunc("month", t).cast("timestamp_ntz")


def month_number(t: Column) -> Column:
    """Months since year 0 of a stamp."""
    return F.year(t) * 12 + F.month(t) - 1


def month_of_number(n: Column) -> Column:
    """Start of the month with that number."""
    return F.make_date(F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)) + 1, F.lit(1)).cast("timestamp_ntz")


def quarter_start(t: Column) -> Column:
    return F.date_trunc("quarter", t).cast("timestamp_ntz")


def quarter_of(t: Column) -> Column:
    """Quarter label of an interval-ending stamp: midnight belongs to the day before."""
    back = t - F.expr("interval 1 microsecond")
    return F.concat(F.year(back).cast("string"), F.lit("Q"), F.quarter(back).cast("string"))


def calendar_quarter(t: Column) -> Column:
    return F.concat(F.year(t).cast("string"), F.lit(" Q"), F.quarter(t).cast("string"))


def quarter_intervals(t: Column, minutes: int = 5) -> Column:
    """Number of intervals in the quarter of an interval-ending stamp."""
    first = F.date_trunc("quarter", t - F.expr("interval 1 microsecond"))
    nxt = F.add_months(first.cast("date"), 3)
    return (F.datediff(nxt, first.cast("date")) * (1440 // minutes)).cast("long")


def financial_year(t: Column) -> Column:
    """Label of the July-to-June year, e.g. FY2025 for July 2024 to June 2025."""
    return F.concat(F.lit("FY"), (F.year(t) + F.when(F.month(t) >= 7, 1).otherwise(0)).cast("string"))


def season(t: Column) -> Column:
    return F.floor((F.month(t) % 12) / 3).cast("int")


def season_name(t: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("Summer", "Autumn", "Winter", "Spring")]), season(t) + 1)


def season_block(t: Column) -> Column:
    """Season with its year; summer is named by both years it touches."""
    last = F.year(t) + F.when(F.month(t) == 12, 1).otherwise(0)
    summer = F.concat(F.lit("Summer "), (last - 1).cast("string"), F.lit("–"), F.lpad((last % 100).cast("string"), 2, "0"))
    return F.when(season(t) == 0, summer).otherwise(F.concat(season_name(t), F.lit(" "), F.year(t).cast("string")))


def complete_quarter(t: Column, start: Column, end: Column) -> Column:
    """True where the calendar quarter of t lies wholly inside [start, end]."""
    first = F.date_trunc("quarter", t).cast("timestamp_ntz")
    nxt = F.add_months(first.cast("date"), 3).cast("timestamp_ntz")
    return (first >= start) & (nxt - F.expr("interval 5 minutes") <= end)


def slot(t: Column) -> Column:
    """Half-hour slot 0..47 of the day."""
    return F.hour(t) * 2 + F.when(F.minute(t) >= 30, 1).otherwise(0)


def slot_distance(a: Column, b: Column, slots: int = 48) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(slots) - d)


def cyclic_terms(t: Column, origin: Column) -> dict[str, Column]:
    hour = (F.hour(t) + F.minute(t) / 60) * (2 * math.pi / 24)
    year = F.dayofyear(t) * (2 * math.pi / 365.25)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "year_sin": F.sin(year), "year_cos": F.cos(year),
            "weekday": F.weekday(t), "trend_days": (micros(t) - micros(origin)) / 86_400_000_000.0}


def day_period(t: Column, cuts: tuple = (6, 10, 16, 21),
               names: tuple = ("overnight", "morning", "midday", "evening")) -> Column:
    """Named part of the day from hour cuts; before the first and after the last cut is the first name."""
    h = F.hour(t)
    out = F.when((h < cuts[0]) | (h >= cuts[3]), names[0])
    for i in range(1, 4):
        out = out.when(h < cuts[i], names[i])
    return out


def parse_time(text: Column) -> Column:
    """Market time text to a stamp; slashes allowed; years from 2200 up mean open-ended (9999-12-31)."""
    t = F.try_to_timestamp(F.regexp_replace(text, "/", "-")).cast("timestamp_ntz")
    return F.when(F.year(t) >= 2200, F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).otherwise(t)


def lead_band(x: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bands: names[i] for edges[i-1] < x <= edges[i]; null x stays null."""
    out = F.when(x.isNull(), F.lit(None))
    for edge, label in zip(edges, names):
        out = out.when(x <= edge, label)
    return out.otherwise(names[-1]) if len(names) > len(edges) else out
