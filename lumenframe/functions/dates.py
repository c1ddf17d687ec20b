"""Date expressions. Weeks start on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOORS = {"fltoyear": "year", "rtoq": "quarter", "fltoquarter": "quarter", "rtomon": "month", "fltomonth": "month", "rtohour": "hour", "fltohour": "hour", "rtomin": "minute", "rtosec": "second"}


def floor_date(x: Column, unit: str) -> Column:
    """Start of the unit; a date for day and above, else a timestamp."""
    if unit == "week":
        return F.date_sub(x.cast("date"), F.dayofweek(x) - 1)
    if unit == "day":
        return x.cast("date")
    out = F.date_trunc(unit, x)
    return out.cast("date") if unit in ("year", "quarter", "month") else out.cast("timestamp_ntz")


def extract_from_date(x: Column, kind: str = "fltoyear") -> Column:
    """Part or floor of a date by token: ``year month day wday week quarter hour halfyear yday ...`` or ``fltoyear rtoq ...``."""
    if kind in _FLOORS:
        return floor_date(x, _FLOORS[kind])
    if kind in ("rtoweek", "fltoweek"):
        return floor_date(x, "week")
    if kind in ("rtoday", "fltoday", "day_floor"):
        return floor_date(x, "day")
    parts = {
        "year": F.year(x), "month": F.month(x), "quarter": F.quarter(x), "day": F.dayofmonth(x), "yday": F.dayofyear(x), "wday": F.dayofweek(x),
        "hour": F.hour(x), "minute": F.minute(x), "second": F.second(x), "halfyear": F.floor((F.month(x) - 1) / 6).cast("int") + 1,
        "week": week(x), "qday": F.datediff(x, F.date_trunc("quarter", x)) + 1, "week_of_month": week_of_month(x), "weekend": weekend(x),
        "wname": F.date_format(x, "EEE"), "wnamelong": F.date_format(x, "EEEE"), "monname": F.date_format(x, "MMM"), "monnamelong": F.date_format(x, "MMMM"),
        "monthday": F.date_format(x, "MM-dd"), "yearmonth": F.date_format(x, "yyyy-MM"),
    }
    if kind not in parts:
        raise ValueError(f"unknown date token {kind}")
    return parts[kind]


def week(x: Column) -> Column:
    """Whole weeks since the first of January, counted from 1 (not ISO)."""
    return F.floor((F.dayofyear(x) - 1) / 7).cast("int") + 1


def week_of_month(x: Column) -> Column:
    """Calendar row of the day in its month, weeks from Sunday."""
    first = F.date_trunc("month", x).cast("date")
    return F.floor((F.dayofmonth(x) + F.dayofweek(first) - 2) / 7).cast("int") + 1


def weekend(x: Column) -> Column:
    return F.when(F.dayofweek(x).isin(1, 7), "Weekend").when(x.isNotNull(), "Weekday")


def last_date(x: Column, unit: str = "month", previous: bool = False) -> Column:
    """Last day of the unit that holds the date, or of the unit before."""
    months = {"month": 1, "quarter": 3, "halfyear": 6, "year": 12}
    if unit == "week":
        end = F.date_add(floor_date(x, "week"), 6)
        return F.date_sub(end, 7) if previous else end
    start = F.make_date(F.year(x), F.lit(1) + F.floor((F.month(x) - 1) / 6).cast("int") * 6, F.lit(1)) if unit == "halfyear" else F.date_trunc(unit, x).cast("date")
    return F.date_sub(start if previous else F.add_months(start, months[unit]), 1)


_SECONDS = {"weeks": 604800.0, "days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}


def time_between(start: Column, end: Column, unit: str) -> Column:
    """Length of the interval; months and years by the calendar: whole ones and the share of the one begun."""
    if unit in _SECONDS:
        micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
        return micros / 1e6 / _SECONDS[unit]
    step = 12 if unit == "years" else 1
    a, b = F.least(start.cast("date"), end.cast("date")), F.greatest(start.cast("date"), end.cast("date"))
    raw = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    whole = raw - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    n = F.floor(whole / step).cast("int")
    at = F.add_months(a, n * step)
    size = F.datediff(F.add_months(a, (n + 1) * step), at)
    length = n + F.datediff(b, at) / size
    return F.when(end < start, -length).otherwise(length).cast("double")


def unixtime_to_datetime(x: Column) -> Column:
    return F.timestamp_seconds(x.cast("double"))


def excel_numeric_to_date(x: Column, date_system: str = "modern") -> Column:
    return F.date_add(F.lit("1899-12-30" if date_system == "modern" else "1904-01-01").cast("date"), F.floor(x).cast("int"))


def excel_numeric_to_datetime(x: Column) -> Column:
    return F.timestamp_seconds((x.cast("double") - 25569) * 86400)


def within_date_range(x: Column, operator: str, today: Column | None = None) -> Column:
    """Relative ranges: ``this_month``, ``last_week``, ``last_n_days:7``, ``year_to_date``, ... against ``today``."""
    today = F.current_date() if today is None else today
    d = x.cast("date")
    name, _, n = operator.partition(":")
    if name.startswith(("this_", "last_", "next_")) and name.count("_") == 1:
        when, unit = name.split("_")
        start = floor_date(today, unit)
        if unit in ("day", "week"):
            size = 7 if unit == "week" else 1
            low = F.date_add(start, {"this": 0, "last": -size, "next": size}[when])
            return (d >= low) & (d < F.date_add(low, size))
        size = {"month": 1, "quarter": 3, "year": 12}[unit]
        low = F.add_months(start, {"this": 0, "last": -size, "next": size}[when])
        return (d >= low) & (d < F.add_months(low, size))
    if name in ("last_n_days", "next_n_days"):
        k = int(n)
        return (d > F.date_sub(today, k)) & (d <= today) if name[0] == "l" else (d >= today) & (d < F.date_add(today, k))
    if name in ("year_to_date", "month_to_date", "quarter_to_date", "week_to_date"):
        return (d >= floor_date(today, name.split("_")[0])) & (d <= today)
    raise ValueError(f"unknown range {operator}")
