"""The six business questions and the filtered explorer, as lazy frames over the fact.

``fact`` is a fact with causes, or a function that returns its named columns: ``saved.select`` for a saved
fact, ``partial(fact_with_causes, tables)`` for one built from the tables. Every frame asks for the columns
it reads, so an answer from the tables makes only the joins it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import (
    COMPARE_RECOMMENDATIONS,
    DEFAULT_TITLE,
    EXPLANATIONS,
    FESTIVAL_MONTH,
    ONBOARDING_VOLUME,
    TITLES,
    WAREHOUSE_MONTH,
)
from shipcause.functions.dates import day_text, last_day_seen, month_bounds, past_week, previous_month
from shipcause.operators import scopes
from shipcause.operators.fact import MONTH
from shipcause.operators.insights import projected_late
from shipcause.operators.measures import (
    SAMPLE_COLUMNS,
    cause_counts,
    kpis,
    recommendations,
    samples,
    top,
    top_causes,
)

Fact = DataFrame | Callable[..., DataFrame]

KPI_COLUMNS = ["status", "is_late"]
DATE_COLUMNS = ["order_date", MONTH]


class Answer(Mapping[str, DataFrame]):
    """The frames of an answer by name; each is planned when it is asked for."""

    def __init__(self, **parts: Callable[[], DataFrame]):
        self._parts = parts

    def __getitem__(self, name: str) -> DataFrame:
        return self._parts[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def _read(fact: Fact, *columns: str) -> DataFrame:
    select = fact.select if isinstance(fact, DataFrame) else fact
    return select(*dict.fromkeys(columns))


def _header(fact: Fact, template: str, scope: Column) -> DataFrame:
    return _read(fact, "order_id").sparkSession.range(1).select(
        F.lit(TITLES.get(template, DEFAULT_TITLE)).alias("title"),
        scope.alias("scope"),
        F.lit(EXPLANATIONS.get(template, "")).alias("explanation"),
    )


def _blank(fact: Fact) -> dict[str, Callable[[], DataFrame]]:
    """Frames without rows, in the usual columns, for the parts that a template does not have."""
    return {
        "kpis": lambda: kpis(_read(fact, *KPI_COLUMNS), F.lit(False)).limit(0),
        "causes": lambda: top_causes(_read(fact, "causes"), F.lit(False)),
        "samples": lambda: samples(_read(fact, *SAMPLE_COLUMNS), F.lit(False)),
        "recommendations": lambda: recommendations(top_causes(_read(fact, "causes"), F.lit(False))),
    }


def _text(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _day(value: scopes.Day) -> Column:
    return day_text(value) if isinstance(value, Column) else F.lit(str(value))


def _standard(
    fact: Fact, template: str, text: Column, scope: Column, reads: list[str], cause_scope: Column | None = None
) -> Answer:
    """KPIs, causes, impacted orders and recommendations of one scope; causes may use a narrower one.

    ``reads`` are the columns that the scopes read.
    """

    def causes() -> DataFrame:
        return top_causes(_read(fact, "causes", *reads), scope if cause_scope is None else cause_scope)

    return Answer(
        header=lambda: _header(fact, template, text),
        kpis=lambda: kpis(_read(fact, *KPI_COLUMNS, *reads), scope),
        causes=causes,
        samples=lambda: samples(_read(fact, *SAMPLE_COLUMNS, *reads), scope),
        recommendations=lambda: recommendations(causes()),
    )


def city_delays(fact: Fact, city: str | Column, start: scopes.Day, end: scopes.Day) -> Answer:
    scope = scopes.all_of(scopes.days_between(start, end, month=MONTH), scopes.equals("city", city))
    text = _text("City=", city, ", Date Range=", _day(start), " to ", _day(end))
    return _standard(fact, "city_delayed_date_range", text, scope, ["city", *DATE_COLUMNS])


def last_week(fact: Fact) -> tuple[Column, Column]:
    return past_week(last_day_seen(_read(fact, "order_date")))


def client_failures(fact: Fact, client: str | Column) -> Answer:
    """Past week of one client: causes of its failed orders, KPIs and samples of all of them."""
    start, end = last_week(fact)
    scope = scopes.all_of(scopes.days_between(start, end, month=MONTH), scopes.equals("client_name", client))
    text = _text("Client=", client, ", Period=", day_text(start), " to ", day_text(end), ", Failed orders only")
    reads = ["client_name", "status", *DATE_COLUMNS]
    return _standard(fact, "client_failures_past_week", text, scope, reads, scope & scopes.failed())


def warehouse_reasons(fact: Fact, warehouse: str | Column, month: str = WAREHOUSE_MONTH) -> Answer:
    scope = scopes.all_of(scopes.in_month(month, month=MONTH), scopes.equals("warehouse_name", warehouse))
    text = _text("Warehouse=", warehouse, f", Month={month}")
    return _standard(fact, "warehouse_august_reasons", text, scope, ["warehouse_name", *DATE_COLUMNS])


def compare_cities(fact: Fact, city: str, city_b: str) -> Answer:
    """Cause counts of two cities in the month before the last order's."""
    start, end = previous_month(last_day_seen(_read(fact, "order_date")))
    scope = scopes.days_between(start, end, month=MONTH) & scopes.one_of("city", [city, city_b])
    reads = ["city", *DATE_COLUMNS]
    text = _text("Cities=", city, " vs ", city_b, ", Period=", day_text(start), " to ", day_text(end))

    def compare() -> DataFrame:
        counts = cause_counts(_read(fact, "causes", *reads), scope, by=["city"])
        return counts.orderBy("city", F.desc("cause_count"), "cause")

    def order_counts() -> DataFrame:
        return _read(fact, *reads).where(scope).agg(
            F.count_if(F.col("city") == city).alias("city_a_orders"),
            F.count_if(F.col("city") == city_b).alias("city_b_orders"),
        )

    def advice() -> DataFrame:
        spark = _read(fact, "order_id").sparkSession
        lines = spark.createDataFrame(list(enumerate(COMPARE_RECOMMENDATIONS)), "position int, recommendation string")
        return lines.orderBy("position").select("recommendation")

    parts = {
        "header": lambda: _header(fact, "city_vs_city_last_month", text),
        "kpis": order_counts,
        "compare": compare,
        "recommendations": advice,
    }
    return Answer(**(_blank(fact) | parts))


def festival_risks(fact: Fact, month: str = FESTIVAL_MONTH) -> Answer:
    first, _ = month_bounds(month)
    text = F.lit(f"Festival window assumed as {first:%B} {first.year}")
    return _standard(fact, "festival_period_risks", text, scopes.in_month(month, month=MONTH), DATE_COLUMNS)


def onboarding_risk(fact: Fact, volume: int = ONBOARDING_VOLUME) -> Answer:
    """Network KPIs, five top causes, and the late orders to expect (from the unrounded rate)."""
    text = F.lit(f"Network baseline + projected {volume:,} additional monthly orders")

    def network() -> DataFrame:
        found = kpis(_read(fact, *KPI_COLUMNS), scopes.everything())
        return found.withColumn("projected_delayed_orders", projected_late(volume))

    def causes() -> DataFrame:
        return top_causes(_read(fact, "causes"), scopes.everything(), 5)

    parts = {
        "header": lambda: _header(fact, "client_onboarding_risk", text),
        "kpis": network,
        "causes": causes,
        "recommendations": lambda: recommendations(causes()),
    }
    return Answer(**(_blank(fact) | parts))


def run_template(
    fact: Fact,
    template: str,
    city: str | Column = "",
    client: str | Column = "",
    warehouse: str | Column = "",
    city_b: str = "",
    start: scopes.Day = "",
    end: scopes.Day = "",
    month: str | None = None,
    volume: int = ONBOARDING_VOLUME,
) -> Answer:
    """The answer to a template as named frames: header, kpis, causes, samples and recommendations for each.

    A part that a template does not have is a frame without rows; of an unknown template that is all but the
    header.
    """
    if template == "city_delayed_date_range":
        return city_delays(fact, city, start, end)
    if template == "client_failures_past_week":
        return client_failures(fact, client)
    if template == "warehouse_august_reasons":
        return warehouse_reasons(fact, warehouse, month or WAREHOUSE_MONTH)
    if template == "city_vs_city_last_month":
        return compare_cities(fact, city, city_b)
    if template == "festival_period_risks":
        return festival_risks(fact, month or FESTIVAL_MONTH)
    if template == "client_onboarding_risk":
        return onboarding_risk(fact, volume)
    return Answer(**(_blank(fact) | {"header": lambda: _header(fact, template, F.lit(""))}))


def explore(
    fact: Fact,
    start: scopes.Day,
    end: scopes.Day,
    city: str = scopes.ALL,
    client: str = scopes.ALL,
    warehouse: str = scopes.ALL,
) -> Answer:
    """KPIs, ten top causes and twenty impacted orders under the explorer's filters."""
    scope = scopes.explorer(start, end, city, client, warehouse, month=MONTH)
    chosen = {"city": city, "client_name": client, "warehouse_name": warehouse}
    reads = [*DATE_COLUMNS, *[name for name, value in chosen.items() if value != scopes.ALL]]
    return Answer(
        kpis=lambda: kpis(_read(fact, *KPI_COLUMNS, *reads), scope),
        causes=lambda: top(cause_counts(_read(fact, "causes", *reads), scope), 10),
        samples=lambda: samples(_read(fact, *SAMPLE_COLUMNS, *reads), scope, 20),
    )
