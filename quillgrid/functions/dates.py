"""Dates of formulas. A date is a Spark date here; formulas hold serials and convert at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(y: Column, m: Column, d: Column) -> Column:
    """Months and days roll over; years up to 1899 count from 1900."""
    y = F.floor(y).cast("int")
    year = F.when(y < 1900, y + 1900).otherwise(y)
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), F.floor(m).cast("int") - 1), F.floor(d).cast("int") - 1)


def weekday(d: Column, kind: int = 1) -> Column:
    """1: Sunday 1; 2: Monday 1; 3: Monday 0."""
    return {1: lambda: F.dayofweek(d), 2: lambda: F.weekday(d) + 1, 3: lambda: F.weekday(d)}[kind]()


def edate(d: Column, months: Column) -> Column:
    return F.add_months(d, months.cast("int"))


def eomonth(d: Column, months: Column) -> Column:
    return F.last_day(F.add_months(d, months.cast("int")))


def whole_months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.day(b) < F.day(a)).cast("int")


def datedif(a: Column, b: Column, unit: str) -> Column:
    """Whole days D, months M, years Y; months past years YM; days past months MD, past years YD. NULL if reversed."""
    months = whole_months(a, b)
    out = {
        "D": F.date_diff(b, a),
        "M": months,
        "Y": F.floor(months / 12).cast("int"),
        "YM": months % 12,
        "MD": F.date_diff(b, F.add_months(a, months)),
        "YD": F.date_diff(b, F.add_months(a, months - months % 12)),
    }[unit.upper()]
    return F.when(a <= b, out)


def weekdays_from_epoch(d: Column) -> Column:
    """Weekdays in the days up to and with ``d``, from a Monday long ago."""
    n = F.date_diff(d, F.lit("1899-01-02").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.lit(5), n % 7 + 1)


def networkdays(a: Column, b: Column, holidays: list[str] | None = None) -> Column:
    """Weekdays from ``a`` to ``b``, both counted, less holidays on weekdays; negative if reversed."""
    low, high = F.least(a, b), F.greatest(a, b)
    n = weekdays_from_epoch(high) - weekdays_from_epoch(F.date_sub(low, 1))
    for day in sorted(set(holidays or [])):
        h = F.lit(day).cast("date")
        n = n - (h.between(low, high) & (F.weekday(h) < 5)).cast("int")
    return F.when(a <= b, n).otherwise(-n).cast("int")
