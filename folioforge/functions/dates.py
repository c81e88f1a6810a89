"""Imprecise dates: bounds by precision, validation, overlap, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ("DAY", "MONTH", "YEAR", "RANGE_YEAR", "UNKNOWN")


def start_bound(precision: Column, year: Column, month: Column, day: Column) -> Column:
    """First day that a date of the precision may mean; null for UNKNOWN or for parts that are no date."""
    month_ok = month.between(1, 12)
    day_ok = month_ok & day.between(1, F.day(F.last_day(F.make_date(year, F.when(month_ok, month).otherwise(1), F.lit(1)))))
    return (
        F.when(precision.isin("YEAR", "RANGE_YEAR"), F.make_date(year, F.lit(1), F.lit(1)))
        .when((precision == "MONTH") & month_ok, F.make_date(year, F.when(month_ok, month), F.lit(1)))
        .when((precision == "DAY") & day_ok, F.make_date(year, F.when(month_ok, month), F.when(day_ok, day)))
    )


def end_bound(precision: Column, year: Column, month: Column, day: Column, end_year: Column) -> Column:
    """Last day that a date of the precision may mean."""
    start = start_bound(precision, year, month, day)
    return (
        F.when(precision == "RANGE_YEAR", F.make_date(end_year, F.lit(12), F.lit(31)))
        .when(precision == "YEAR", F.make_date(year, F.lit(12), F.lit(31)))
        .when(precision == "MONTH", F.last_day(start))
        .otherwise(start)
    )


def overlaps(precision: Column, start: Column, end: Column, low: int, high: int) -> Column:
    """Whether [start, end] meets the years low to high; UNKNOWN never does."""
    known = (precision != "UNKNOWN") & start.isNotNull() & end.isNotNull()
    return known & (start <= F.make_date(F.lit(high), F.lit(12), F.lit(31))) & (end >= F.make_date(F.lit(low), F.lit(1), F.lit(1)))


def label(precision: Column, start: Column, end: Column) -> Column:
    return (
        F.when(precision == "YEAR", F.date_format(start, "yyyy"))
        .when(precision == "MONTH", F.date_format(start, "MM/yyyy"))
        .when(precision == "DAY", F.date_format(start, "dd/MM/yyyy"))
        .when(precision == "RANGE_YEAR", F.concat(F.date_format(start, "yyyy"), F.lit("-"), F.date_format(end, "yyyy")))
        .otherwise("")
    )


def parts(raw: Column) -> Column:
    """(year, month, day) of an ISO date; null for what is none."""
    day = F.try_to_date(F.when(F.trim(raw).rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.trim(raw)), "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.day(day).alias("day")))


def stored_error(precision: Column, start: Column, end: Column) -> Column:
    """date_precision or date_end, whichever of a stored date is wrong first; null for a good one."""
    known = F.coalesce(precision.isin(*PRECISIONS), F.lit(False))
    return F.when(~known, "date_precision").when(end < start, "date_end")


def year_filter(raw_from: str | None, raw_to: str | None, strict: bool = True) -> tuple[int, int] | str | None:
    """(low, high) of a year filter; an error code in strict mode; None for no filter."""
    clean = [None if x is None or not x.strip() else x.strip() for x in (raw_from, raw_to)]
    number = [int(x) if x and x.isascii() and x.isdigit() and 1 <= int(x) <= 9999 else None for x in clean]
    if clean[0] is None:
        return None if clean[1] is None or not strict else "from_missing"
    if number[0] is None:
        return "from_invalid" if strict else None
    if clean[1] is None:
        return number[0], number[0]
    if number[1] is None:
        return "to_invalid" if strict else (number[0], number[0])
    if number[1] < number[0]:
        return "reversed" if strict else (number[0], number[0])
    return number[0], number[1]
