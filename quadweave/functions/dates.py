"""Partial dates as closed day intervals: struct<start, end, day_precise>."""

from pyspark.sql import Column, functions as F

INTERVAL_TYPE = "struct<start:date,end:date,day_precise:boolean>"
TIMEZONE = r"(?<=\d)(Z|[+-]\d{2}:\d{2})$"


def interval(start: Column, end: Column, day_precise) -> Column:
    exact = day_precise if isinstance(day_precise, Column) else F.lit(day_precise)
    return F.struct(start.alias("start"), end.alias("end"), exact.alias("day_precise")).cast(
        INTERVAL_TYPE
    )


def _day(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def _clean(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(raw), r"^(\d{4}-\d{2}-\d{2})T.*$", "$1")
    return F.regexp_replace(s, TIMEZONE, "")


def _single(s: Column) -> Column:
    year = F.rpad(s, 10, "-01-01")
    month = F.rpad(s, 10, "-01")
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), interval(_day(s), _day(s), True))
        .when(s.rlike(r"^\d{4}-\d{2}$"), interval(_day(month), F.last_day(_day(month)), False))
        .when(s.rlike(r"^\d{4}$"), interval(_day(year), _day(F.rpad(s, 10, "-12-31")), False))
    )


def _combine(parts: Column) -> Column:
    low, high = parts[0], F.element_at(parts, -1)
    known = low["start"].isNotNull() & high["end"].isNotNull() & (low["start"] <= high["end"])
    return F.when(
        known,
        F.when(F.size(parts) == 1, low).otherwise(
            interval(low["start"], high["end"], low["day_precise"] & (low == high))
        ),
    )


def parse_partial_date(col) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD, a dateTime, or ``start/end`` of those; anything else is null."""
    s = F.trim(F.col(col) if isinstance(col, str) else col)
    parts = F.when(F.instr(s, "/") > 1, F.split(s, "/", 2)).otherwise(F.array(s))
    # The nested lambdas bind each step once; written as plain columns the steps would be repeated.
    intervals = F.transform(F.transform(parts, _clean), _single)
    return F.transform(F.array(intervals), _combine)[0]


def interval_overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def show_interval(i: Column) -> Column:
    return F.when(i["day_precise"], i["start"].cast("string")).otherwise(
        F.concat_ws("/", i["start"].cast("string"), i["end"].cast("string"))
    )


def parse_number(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c).try_cast("double")
