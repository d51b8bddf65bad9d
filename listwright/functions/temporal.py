"""Dates and instants. The listings' zone is fixed; a date is never turned into an instant but for ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone of all listings and its offset for feeds that state a time of day, and the named periods.
ZONE, FEED_OFFSET = "America/Sao_Paulo", "-03:00"
PERIODS = ["today", "tomorrow", "weekend", "this_week", "this_month"]


def is_calendar_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def local_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), ZONE))


def effective_instant(kind: Column, starts_at: Column, start_date: Column) -> Column:
    """For ordering only: a date counts as its local midnight."""
    return F.when(kind == "timed", starts_at.cast("timestamp")).otherwise(F.to_utc_timestamp(start_date.cast("timestamp"), ZONE))


def local_start(kind: Column, starts_at: Column, start_date: Column) -> Column:
    return F.when(kind == "timed", local_date(starts_at)).otherwise(start_date)


def local_end(kind: Column, starts_at: Column, ends_at: Column, start_date: Column, end_date: Column) -> Column:
    return F.when(kind == "timed", local_date(F.coalesce(ends_at, starts_at))).otherwise(F.coalesce(end_date, start_date))


def utc_day(instant: Column) -> Column:
    """Its date in UTC, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant.cast("timestamp")) / 86_400_000_000).cast("int"))


def period_range(period: Column, now: Column) -> Column:
    """Inclusive struct<start, end> of a named period around the instant `now`; null for other names."""
    today = local_date(now)
    monday = F.to_date(F.trunc(today, "week"))

    def days(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"))

    return (
        F.when(period == "today", days(today, today))
        .when(period == "tomorrow", days(F.date_add(today, 1), F.date_add(today, 1)))
        .when(period == "weekend", days(F.date_add(monday, 5), F.date_add(monday, 6)))
        .when(period == "this_week", days(monday, F.date_add(monday, 6)))
        .when(period == "this_month", days(F.to_date(F.trunc(today, "month")), F.last_day(today)))
    )


def date_range_error(period: Column, start: Column, end: Column) -> Column:
    """Error code of a request's date parameters, null if they are good."""
    one, other = start.isNotNull(), end.isNotNull()
    good = is_calendar_date(start) & is_calendar_date(end)
    return (
        F.when(period.isNotNull() & (one | other), "invalid-filter-combination")
        .when(period.isNotNull() & ~period.isin(PERIODS), "invalid-period")
        .when(period.isNull() & (one != other), "invalid-filter-combination")
        .when(one & other & ~good, "invalid-date")
        .when(one & other & (start > end), "invalid-date")
    )


def date_range(period: Column, start: Column, end: Column, now: Column) -> Column:
    """struct<start, end> of good parameters; null without any."""
    given = F.when(start.isNotNull(), F.struct(F.try_to_date(start, "yyyy-MM-dd").alias("start"), F.try_to_date(end, "yyyy-MM-dd").alias("end")))
    return F.when(date_range_error(period, start, end).isNull(), F.coalesce(period_range(period, now), given))
