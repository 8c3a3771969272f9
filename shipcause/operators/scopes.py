"""Filters: conditions on fact columns that select the orders a question is about."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from shipcause.functions.dates import month_bounds, month_text
from shipcause.functions.values import column

Day = str | dt.date | Column
ALL = "All"


def everything() -> Column:
    return F.lit(True)


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, joined by AND; everything when there is none."""
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else everything()


def equals(name: str, value: str | Column | None) -> Column | None:
    """Exact match; no condition for None and for ``All``."""
    if value is None or (isinstance(value, str) and value == ALL):
        return None
    return F.col(name) == F.lit(value)


def equals_ignore_case(name: str, value: str | None) -> Column | None:
    return F.lower(name) == F.lit(value.lower()) if value else None


def matches(name: str, pattern: str | None) -> Column | None:
    """The regular expression occurs in the text, case apart; NULL does not match."""
    return F.coalesce(F.col(name).rlike("(?iu)" + pattern), F.lit(False)) if pattern else None


def one_of(name: str, values: list) -> Column:
    return F.col(name).isin(*values)


def failed(name: str = "status") -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit(""))) == "failed"


def as_day(value: Day) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


def days_between(start: Day, end: Day, name: str = "order_date", month: str | None = None) -> Column:
    """Whole days, both ends included.

    ``month`` names a ``yyyy-MM`` column of the same date that the table is partitioned by; the condition
    then also selects partitions.
    """
    start, end = as_day(start), as_day(end)
    inside = F.to_date(column(name)).between(start, end)
    return inside if month is None else inside & F.col(month).between(month_text(start), month_text(end))


def in_month(value: str, name: str = "order_date", month: str | None = None) -> Column:
    """The calendar month ``YYYY-MM`` as a half-open range, which reaches the Parquet scan."""
    first, after = month_bounds(value)
    inside = (F.col(name) >= F.lit(first).cast("timestamp_ntz")) & (F.col(name) < F.lit(after).cast("timestamp_ntz"))
    return inside if month is None else inside & (F.col(month) == value)


def from_instant(start: str | None, name: str = "order_date") -> Column | None:
    return F.col(name) >= F.lit(start).cast("timestamp_ntz") if start else None


def until_instant(end: str | None, name: str = "order_date") -> Column | None:
    """Up to the instant itself: a bare date means its midnight, so later orders of that day are out."""
    return F.col(name) <= F.lit(end).cast("timestamp_ntz") if end else None


def orders_matching(
    city: str | None = None,
    client: str | None = None,
    warehouse: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> Column:
    """The CLI's optional filters: city ignoring case, client and warehouse as patterns, two instants."""
    return all_of(
        equals_ignore_case("city", city),
        matches("client_name", client),
        matches("warehouse_name", warehouse),
        from_instant(start),
        until_instant(end),
    )


def explorer(
    start: Day, end: Day, city: str = ALL, client: str = ALL, warehouse: str = ALL, month: str | None = None
) -> Column:
    """The explorer's filters: a day range, and exact values where they are not ``All``."""
    return all_of(
        days_between(start, end, month=month),
        equals("city", city),
        equals("client_name", client),
        equals("warehouse_name", warehouse),
    )


def all_present(*names: str) -> Column:
    """None of the columns is NULL."""
    return all_of(*[F.col(n).isNotNull() for n in names])


def range_complete(ranges) -> bool:
    """All four ends of the known date ranges are there (``ranges``: the row of ``date_ranges``)."""
    return all(
        ranges[name] for name in ("order_min_date", "order_max_date", "dataset_min_date", "dataset_max_date")
    )
