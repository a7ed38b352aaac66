"""Calendar arithmetic on dates and local wall-clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(day: Column) -> Column:
    """The calendar month's last day."""
    return F.last_day(day)


def prior_month_end(day: Column) -> Column:
    """The last day of the month before."""
    return F.date_sub(F.trunc(day, "MM"), 1)


def lag_month(day: Column, n: int) -> Column:
    """The month end n months back."""
    return F.last_day(F.add_months(F.trunc(day, "MM"), -n))


def trailing_start(day: Column, months: int) -> Column:
    """First day of the trailing window of whole months that ends in the day's month."""
    return F.add_months(F.trunc(day, "MM"), 1 - months)


def local_day_start(day: Column, zone: str | Column) -> Column:
    """Microseconds of the local day's first instant; the session runs in UTC."""
    return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone))


def local_day_end(day: Column, zone: str | Column) -> Column:
    """The local day's last microsecond, from the next day's start, so DST days are right."""
    return local_day_start(F.date_add(day, 1), zone) - 1


def local_date(us: Column, zone: str) -> Column:
    """The local date of an instant."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def period_date(text: Column) -> Column:
    """First day of a period written YYYY, YYYY-MM, YYYY-Qn, YYYYMMDD or YYYY-MM-DD."""
    quarter = F.concat(F.substring(text, 1, 4), F.lit("-"), F.lpad((F.substring(text, 7, 1).try_cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01"))
    return (
        F.when(text.rlike(r"\A[0-9]{4}\z"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
        .when(text.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
        .when(text.rlike(r"\A[0-9]{4}-Q[1-4]\z"), F.try_to_date(quarter, "yyyy-MM-dd"))
        .when(text.rlike(r"\A[0-9]{8}\z"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
    )
