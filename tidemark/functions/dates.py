"""Date arithmetic as Column expressions; all dates are UTC calendar dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtract_years(d: Column, years: int) -> Column:
    """The same day years before; February 29 becomes March 1 where the target year has none."""
    year = F.year(d) - years
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    trap = (F.month(d) == 2) & (F.dayofmonth(d) == 29) & ~leap
    return F.when(trap, F.make_date(year, F.lit(3), F.lit(1))).otherwise(F.add_months(d, -12 * years))


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_end(d: Column) -> Column:
    return F.last_day(d)


def ratio_date_key(text: Column) -> Column:
    """ISO dates as they are, a bare year as its last day, anything else null."""
    text = F.trim(text)
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(
        text.rlike("^[0-9]{4}$"), F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd")
    )


def epoch_date(c: Column) -> Column:
    """Seconds or, above 1e12, milliseconds since 1970 to a date; null at or below zero."""
    seconds = F.when(c > 1e12, c / 1000).when(c > 0, c)
    return F.to_date(F.timestamp_seconds(F.floor(seconds)))


#: Month names are known by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _month_number(month: Column) -> Column:
    at = F.array_position(F.split(F.lit(MONTHS), " "), F.lower(F.substring(F.trim(month), 1, 3))).cast("int")
    return F.when(at > 0, at)


def _year_number(year: Column) -> Column:
    y = F.trim(year).try_cast("int")
    return F.when(y.between(1800, 2200), y)


def month_year_date(month: Column, year: Column) -> Column:
    """A month's name and a year to the month's last day."""
    return F.last_day(F.make_date(_year_number(year), _month_number(month), F.lit(1)))


def month_day_year_date(month: Column, day: Column, year: Column) -> Column:
    """Month name, day and year; a day past the month's end runs on into the next."""
    d = F.trim(day).try_cast("int")
    return F.date_add(F.make_date(_year_number(year), _month_number(month), F.lit(1)), F.when(d.between(1, 31), d) - 1)


def slash_date(text: Column) -> Column:
    """m/d/yyyy or m/d/yy, two-digit years from 70 on in the last century; days past the month's end run on."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", k).try_cast("int")
    short = F.length(F.regexp_extract(F.trim(text), r"/(\d+)$", 1)) == 2
    y = F.when(short, part(3) + F.when(part(3) >= 70, 1900).otherwise(2000)).otherwise(part(3))
    ok = part(1).between(1, 12) & part(2).between(1, 31) & y.between(1800, 2200)
    return F.when(ok, F.date_add(F.make_date(F.when(ok, y), F.when(ok, part(1)), F.lit(1)), F.when(ok, part(2)) - 1))


def month_end_of(text: Column) -> Column:
    """Thirteen digits as milliseconds, ten as seconds, yyyy-MM-dd (also with more after it), yyyy-MM, the same with
    slashes, or m/d/yyyy: the last day of the month meant."""
    t = F.trim(text)
    seconds = F.when(t.rlike(r"^\d{13}$"), F.floor(t.try_cast("double") / 1000)).when(t.rlike(r"^\d{10}$"), t.try_cast("double"))
    dashed = F.replace(t, F.lit("/"), F.lit("-"))
    plain = t.rlike(r"^\d{4}-\d{2}-\d{2}") | t.rlike(r"^\d{4}/\d{2}/\d{2}$")
    day = F.when(plain, F.try_to_date(F.substring(dashed, 1, 10), "yyyy-MM-dd"))
    month = F.when(t.rlike(r"^\d{4}[-/]\d{2}$"), F.try_to_date(F.concat(dashed, F.lit("-01")), "yyyy-MM-dd"))
    slashed = F.when(t.rlike(r"/\d{4}$"), slash_date(t))
    return F.last_day(F.coalesce(F.to_date(F.timestamp_seconds(seconds)), day, month, slashed))


def text_date(text: Column) -> Column:
    """Dates written as yyyy-MM-dd, MM/dd/yyyy or yyyy/MM/dd; impossible ones are null."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd")])


def weekdays_between(a: Column, b: Column) -> Column:
    """The weekdays strictly between two dates, as an array."""
    days = F.when(F.datediff(b, a) > 1, F.sequence(F.date_add(a, 1), F.date_sub(b, 1))).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda x: ~F.dayofweek(x).isin(1, 7))


def last_market_date(now: Column, close_hour: int = 16) -> Column:
    """The last weekday whose New York session is over; holidays are not known."""
    local = F.from_utc_timestamp(now, "America/New_York")
    day = F.when(F.hour(local) >= close_hour, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return F.date_sub(day, F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0))


def ordered_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Two dates in order; a missing one stays open."""
    swap = start > end
    return F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)
