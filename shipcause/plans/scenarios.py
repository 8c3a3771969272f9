"""The narrative scenarios: insights for named scopes of the CLI fact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from shipcause.fixed import ONBOARDING_VOLUME
from shipcause.operators import scopes
from shipcause.operators.insights import insights, insights_with_onboarding


def _period(start: str | None, end: str | None) -> Column:
    return scopes.orders_matching(start=start, end=end)


def city_scenario(fact: DataFrame, title: str, city: str) -> DataFrame:
    return insights(fact, {title: scopes.orders_matching(city=city)})


def client_scenario(fact: DataFrame, title: str, client: str) -> DataFrame:
    return insights(fact, {title: scopes.orders_matching(client=client)})


def warehouse_scenario(fact: DataFrame, title: str, warehouse: str, start: str, end: str) -> DataFrame:
    return insights(fact, {title: scopes.orders_matching(warehouse=warehouse, start=start, end=end)})


def peak_scenario(fact: DataFrame, title: str, start: str, end: str) -> DataFrame:
    return insights(fact, {title: _period(start, end)})


def compare_cities(fact: DataFrame, city_a: str, city_b: str, start: str, end: str) -> DataFrame:
    """One insight per city, both in one pass; a city compared with itself is answered twice."""
    found = insights(fact, {c: scopes.orders_matching(city=c, start=start, end=end) for c in (city_a, city_b)})
    return found.unionByName(found) if city_a == city_b else found


@dataclass(frozen=True)
class Scenarios:
    """What the six scenarios ask about."""

    city: str
    client: str
    warehouse: str
    month: tuple[str, str]
    cities: tuple[str, str]
    peak: tuple[str, str]
    new_client: str
    volume: int = ONBOARDING_VOLUME

    def scopes(self) -> dict[str, Column]:
        start, end = self.month
        a, b = self.cities
        return {
            f"City {self.city}": scopes.orders_matching(city=self.city),
            f"Client {self.client}": scopes.orders_matching(client=self.client),
            f"Warehouse {self.warehouse} {start} to {end}": scopes.orders_matching(
                warehouse=self.warehouse, start=start, end=end
            ),
            f"Compare {a}": scopes.orders_matching(city=a, start=start, end=end),
            f"Compare {b}": scopes.orders_matching(city=b, start=start, end=end),
            f"Peak {self.peak[0]} to {self.peak[1]}": _period(*self.peak),
        }


def answer_all(fact: DataFrame, ask: Scenarios) -> DataFrame:
    """All scenarios as insight rows, in one pass over the orders for all of them."""
    return insights_with_onboarding(fact, ask.scopes(), ask.new_client, ask.volume)
