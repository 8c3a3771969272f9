"""Column expressions for dates, durations and calendar windows.

All of them work on ``timestamp_ntz`` and give the same result in every session time zone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.functions.values import column

def micros_between(start: str | Column, end: str | Column) -> Column:
    gap = (column(end) - column(start)).cast("interval second")
    return (gap.cast("decimal(18,6)") * 1_000_000).cast("bigint")


def hours_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(3.6e9)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(6.0e7)


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: Dates written as one number.
COMPACT = ("yyyyMMdd", "yyyyMMddHHmm", "yyyyMMddHHmmss")


def try_timestamp(c: str | Column, formats: tuple[str, ...] = ()) -> Column:
    """Timestamp in the text (ISO forms, compact ones, then ``formats`` in turn), NULL when none fits."""
    c = column(c)

    def by_format(pattern: str) -> Column:  # read as UTC, so that no wall-clock time is missing or doubled
        instant = F.try_to_timestamp(F.concat(c, F.lit(" Z")), F.lit(pattern + " X"))
        return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(EPOCH))

    compact = [F.when(F.trim(c).rlike(f"^[0-9]{{{len(f)}}}$"), by_format(f)) for f in COMPACT]
    return F.coalesce(c.try_cast("timestamp_ntz"), *compact, *[by_format(f) for f in formats])


def strict_timestamp(c: str | Column) -> Column:
    """Timestamp in the text; the job fails on a text that is none (ANSI cast)."""
    return column(c).cast("timestamp_ntz")


def epoch_nanos(c: str | Column) -> Column:
    """Timestamp for a text that holds nanoseconds since 1970, NULL when it is not a number."""
    c = column(c)
    nanos = F.coalesce(c.try_cast("bigint"), F.floor(c.try_cast("double")).try_cast("bigint"))
    micros = F.floor(nanos / F.lit(1000).cast("decimal(5,0)")).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def to_second(c: str | Column) -> Column:
    """Drop the fraction of a second."""
    c = column(c)
    fraction = F.extract(F.lit("SECOND"), c) % 1
    return c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fraction)


def second_text(c: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, without the fraction of a second."""
    return F.substring(column(c).cast("string"), 1, 19)


def date_texts(df: DataFrame, names: list[str]) -> list[str]:
    """Those of ``names`` that the table holds as text."""
    return [n for n in names if n in df.columns and df.schema[n].dataType.typeName() == "string"]


def normalize_dates(
    df: DataFrame, names: list[str], formats: tuple[str, ...] = (), some_parse: Mapping[str, bool] | None = None
) -> DataFrame:
    """Parse the date columns that the table has, to whole seconds; a bad value becomes NULL.

    A column in which *no* value parses is read as epoch nanoseconds instead. Unless the caller knows in which
    columns some do (``some_parse``), that is counted by one scalar subquery for all columns, so the plan stays lazy and
    scans the table twice at most.
    """
    text = date_texts(df, names)
    typed = [n for n in names if n in df.columns and n not in text]
    out = {n: to_second(n) for n in typed}
    if some_parse is not None:
        out |= {n: to_second(try_timestamp(n, formats) if some_parse[n] else epoch_nanos(n)) for n in text}
    elif text:
        parsed = df.agg(F.struct(*[F.count(try_timestamp(n, formats)).alias(n) for n in text])).scalar()
        for n in text:
            value = F.when(parsed[n] > 0, try_timestamp(n, formats)).otherwise(epoch_nanos(n))
            out[n] = to_second(value)
    return df.withColumns(out) if out else df


def month_bounds(month: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of ``YYYY-MM`` and of the month after it."""
    first = dt.datetime.strptime(month, "%Y-%m")
    after = dt.datetime(first.year + first.month // 12, first.month % 12 + 1, 1)
    return first, after


def last_day_seen(df: DataFrame, name: str = "order_date") -> Column:
    """Latest calendar day of the column over the whole table, as a scalar subquery; today when empty."""
    return F.coalesce(F.to_date(df.agg(F.max(name)).scalar()), F.current_date())


def previous_month(day: Column) -> tuple[Column, Column]:
    """First and last day of the calendar month before the one that holds ``day``."""
    before = F.add_months(day, -1)
    return F.trunc(before, "MM"), F.last_day(before)


def past_week(day: Column) -> tuple[Column, Column]:
    """The day seven days back, and the day itself."""
    return F.date_sub(day, 7), day


def ordered_days(a: Column, b: Column) -> tuple[Column, Column]:
    """Two days, missing ones replaced by today, the earlier first."""
    a, b = F.coalesce(F.to_date(a), F.current_date()), F.coalesce(F.to_date(b), F.current_date())
    return F.least(a, b), F.greatest(a, b)


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def month_text(c: str | Column) -> Column:
    return F.date_format(column(c), "yyyy-MM")
