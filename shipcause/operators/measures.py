"""KPIs, cause counts, impacted orders, recommendations and value lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import DASHBOARD_ACTIONS, DASHBOARD_DEFAULT_ACTION
from shipcause.functions.values import round_half_up
from shipcause.operators.causes import action_for
from shipcause.operators.scopes import everything, failed

SAMPLE_COLUMNS = ["order_id", "city", "client_name", "warehouse_name", "delay_hours", "status"]


def late_rate() -> Column:
    """Share of late rows in percent, 0 for no rows."""
    return F.coalesce(F.avg(F.col("is_late").cast("int")) * 100.0, F.lit(0.0))


def failed_rate() -> Column:
    return F.coalesce(F.avg(F.when(failed(), 1.0).otherwise(0.0)) * 100.0, F.lit(0.0))


def kpis(fact: DataFrame, scope: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Orders, late rate and failed rate of the scope, in total or for each value of ``by``."""
    rows = fact.where(everything() if scope is None else scope)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_orders"),
        late_rate().alias("late_rate"),
        failed_rate().alias("failed_rate"),
    )


def cause_counts(fact: DataFrame, scope: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """How often each cause occurs in the scope, straight from the fact's ``causes`` arrays.

    ``order_id`` is the key of the fact, so this equals joining the exploded causes back to it, without
    the join (see :func:`joined_cause_counts` for tables in which the key repeats).
    """
    rows = fact.where(everything() if scope is None else scope)
    # The outer form spares evaluating the array a second time in a filter on its size.
    return (
        rows.select(*by, F.explode_outer("causes").alias("cause"))
        .where(F.col("cause").isNotNull())
        .groupBy(*by, "cause")
        .agg(F.count(F.lit(1)).alias("cause_count"))
    )


def joined_cause_counts(
    causes: DataFrame, fact: DataFrame, scope: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``causes JOIN fact USING (order_id)`` per cause, as a count.

    Both sides are counted per order first and the counts multiplied, so a repeated ``order_id`` costs
    one row per order and cause instead of all its pairs. The counts are decimal(38,0), since such products
    may exceed bigint.
    """
    scoped = fact.where(everything() if scope is None else scope)
    fact_rows = scoped.groupBy("order_id", *by).agg(F.count(F.lit(1)).alias("fact_rows"))
    cause_rows = causes.groupBy("order_id", "cause").agg(F.count(F.lit(1)).alias("cause_rows"))
    return (
        cause_rows.join(fact_rows, "order_id")
        .groupBy(*by, "cause")
        .agg(F.sum(F.col("cause_rows").cast("decimal(19,0)") * F.col("fact_rows").cast("decimal(19,0)")).alias("cause_count"))
    )


def top(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent causes; equal counts go by name."""
    return counts.orderBy(F.desc("cause_count"), "cause").limit(k)


def top_causes(fact: DataFrame, scope: Column | None = None, k: int = 10) -> DataFrame:
    return top(cause_counts(fact, scope), k)


def samples(fact: DataFrame, scope: Column | None = None, k: int = 10) -> DataFrame:
    """The ``k`` orders with the longest delay; equal delays go by order id."""
    rows = fact.where(everything() if scope is None else scope)
    return (
        rows.orderBy(F.desc_nulls_last("delay_hours"), "order_id")
        .limit(k)
        .withColumn("delay_hours", round_half_up("delay_hours"))
        .select(*SAMPLE_COLUMNS)
    )


def recommendations(
    top_counts: DataFrame,
    k: int = 3,
    actions: Mapping[str, str] = DASHBOARD_ACTIONS,
    default: str = DASHBOARD_DEFAULT_ACTION,
) -> DataFrame:
    """``cause: action`` for the ``k`` most frequent causes."""
    text = F.concat("cause", F.lit(": "), action_for("cause", actions, default))
    return top(top_counts, k).select("cause", text.alias("recommendation"))


def distinct_values(fact: DataFrame, name: str) -> DataFrame:
    """The values of a column that occur, in order: what a filter can offer."""
    return fact.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)


def city_report(fact: DataFrame, k: int = 10) -> DataFrame:
    """Orders and rounded late rate per city, worst first."""
    per_city = fact.groupBy("city").agg(
        F.count(F.lit(1)).alias("total_orders"),
        round_half_up(F.avg("is_late") * 100).alias("late_rate_pct"),
    )
    return per_city.orderBy(F.desc("late_rate_pct"), "city").limit(k)


# First and last date column of each table.
RANGE_COLUMNS = {
    "dim_warehouses": ("created_at", "created_at"),
    "dim_clients": ("created_at", "created_at"),
    "dim_drivers": ("created_at", "created_at"),
    "raw_orders": ("order_date", None),
    "raw_fleet_logs": ("departure_time", "arrival_time"),
    "raw_warehouse_logs": ("picking_start", "dispatch_time"),
    "raw_external_factors": ("recorded_at", "recorded_at"),
    "raw_feedback": ("created_at", "created_at"),
}


def date_ranges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: first and last day of the orders, and of all tables together."""

    def ends(name: str) -> DataFrame:
        first, last = RANGE_COLUMNS[name]
        until = F.coalesce("actual_delivery_date", "promised_delivery_date") if last is None else F.col(last)
        return tables[name].agg(
            F.to_date(F.min(first)).alias("min_date"),
            F.to_date(F.max(until)).alias("max_date"),
        ).withColumn("source", F.lit(name))

    per_table = reduce(DataFrame.unionByName, [ends(name) for name in RANGE_COLUMNS])
    orders = F.col("source") == "raw_orders"
    return per_table.agg(
        F.min(F.when(orders, F.col("min_date"))).alias("order_min_date"),
        F.max(F.when(orders, F.col("max_date"))).alias("order_max_date"),
        F.min("min_date").alias("dataset_min_date"),
        F.max("max_date").alias("dataset_max_date"),
    )


def model_stats(fact: DataFrame) -> DataFrame:
    """Fact rows, cause rows and distinct causes as (metric, value) rows.

    One pass: every order is exploded to its causes and a NULL entry that stands for the order itself, and
    counted by name, so the second aggregate sees a handful of rows.
    """
    entry = F.explode_outer(F.concat(F.coalesce("causes", F.array().cast("array<string>")), F.array(F.lit(None).cast("string"))))
    counts = fact.select(entry.alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    stats = counts.agg(
        F.coalesce(F.sum(F.when(F.col("cause").isNull(), F.col("n"))), none).alias("fact_order_analysis_rows"),
        F.coalesce(F.sum(F.when(F.col("cause").isNotNull(), F.col("n"))), none).alias("fact_order_causes_rows"),
        F.count("cause").alias("unique_causes"),
    )
    return stats.unpivot([], ["fact_order_analysis_rows", "fact_order_causes_rows", "unique_causes"], "metric", "value")
