"""The log grain: what a join of orders, warehouse logs and fleet logs counts, without making its rows.

An order with m warehouse logs and n fleet logs is m x n rows of that join. Its rows are independent
choices of one log on either side, so every count over them follows from counts per side:
a rule that holds for a of the m warehouse logs and b of the n fleet logs holds for
m*n - (m-a)*(n-b) pairs, and for all of them when the order itself meets it. Each log is therefore
aggregated once per order, and the pairs never exist.

Counts of pairs outgrow bigint soon (an order with 200,000 logs on either side, joined back, is beyond it),
so they are decimal(38,0). A number beyond that fails the job instead of coming out wrong.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import UNKNOWN_CAUSE
from shipcause.operators.causes import FEEDBACK, MODEL_RULES, TEXT, Rule, cause_conditions, feedback_holds, needles
from shipcause.operators.fact import (
    Tables,
    WAREHOUSE_DIM_COLUMNS,
    client_dim,
    delay_columns,
    dispatch_lag_minutes,
    picking_minutes,
    warehouse_dim,
)
from shipcause.operators.feedback import feedback_summary_model
from shipcause.operators.firsts import worst_factor
from shipcause.operators.measures import failed, top

ANY = "any"
SIDE_COUNT = "decimal(19,0)"  # holds any bigint
PAIR_COUNT = "decimal(38,0)"


def _met_in(rules: Sequence[Rule], fields: Mapping[str, Column]) -> dict[str, Column]:
    """Conditions of the rules that these fields can decide, and whether any of them is met."""
    met = cause_conditions([r for r in rules if r.column in fields], fields)
    met = {cause: F.coalesce(c, F.lit(False)) for cause, c in met.items()}
    return {**met, ANY: reduce(or_, met.values(), F.lit(False))}


def _side(log: DataFrame, met: Mapping[str, Column], prefix: str) -> DataFrame:
    """Per order the number of logs, and of logs that meet each cause."""
    return log.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count(F.lit(1)).alias(prefix),
        *[F.count_if(c).alias(f"{prefix}_{cause}") for cause, c in met.items()],
    )


def log_grain(tables: Tables, rules: Sequence[Rule] = MODEL_RULES) -> DataFrame:
    """Per order: its columns, ``fact_rows`` (join rows) and ``<cause>_rows`` (join rows with the cause)."""
    stock_fields = {
        TEXT: F.lower("notes"),
        "picking_minutes": picking_minutes(),
        "dispatch_lag_minutes": dispatch_lag_minutes(),
    }
    stock_met = _met_in(rules, stock_fields)
    fleet_met = _met_in(rules, {TEXT: F.lower("gps_delay_notes")})

    orders = (
        tables["raw_orders"]
        .join(client_dim(tables["dim_clients"]), "client_id", "left")
        .join(_side(tables["raw_warehouse_logs"], stock_met, "m"), "order_id", "left")
        .join(_side(tables["raw_fleet_logs"], fleet_met, "n"), "order_id", "left")
        .join(worst_factor(tables["raw_external_factors"], "model"), "order_id", "left")
        .join(feedback_summary_model(tables["raw_feedback"], needles(rules)), "order_id", "left")
        .withColumns(delay_columns("model"))
    )
    order_fields = {
        TEXT: F.lower("failure_reason"),
        FEEDBACK: feedback_holds(orders),
        **{c: F.col(c) for c in ("traffic_score", "weather_condition", "event_type", "is_late")},
    }
    order_met = _met_in(rules, order_fields)

    def logs(prefix: str) -> Column:  # an order without logs still is one row
        return F.coalesce(F.col(prefix), F.lit(1)).cast(SIDE_COUNT)

    def without(prefix: str, met: Mapping[str, Column], cause: str) -> Column:
        if cause not in met:
            return logs(prefix)
        return (F.coalesce(F.col(prefix), F.lit(1)) - F.coalesce(F.col(f"{prefix}_{cause}"), F.lit(0))).cast(SIDE_COUNT)

    pairs = logs("m") * logs("n")
    causes = sorted({r.cause for r in rules})
    counts = {
        cause: F.when(order_met.get(cause, F.lit(False)), pairs).otherwise(
            pairs - without("m", stock_met, cause) * without("n", fleet_met, cause)
        )
        for cause in causes
    }
    counts[UNKNOWN_CAUSE] = F.when(order_met[ANY], F.lit(0).cast(PAIR_COUNT)).otherwise(
        without("m", stock_met, ANY) * without("n", fleet_met, ANY)
    )
    return orders.select(
        "order_id", "client_name", "city", "status", "order_date", "is_late", "delay_hours", "feedback_rating_avg",
        pairs.alias("fact_rows"),
        logs("m").cast("bigint").alias("warehouse_rows"),
        logs("n").cast("bigint").alias("fleet_rows"),
        *[n.cast(PAIR_COUNT).alias(f"{cause}_rows") for cause, n in counts.items()],
    )


def cause_names(rules: Sequence[Rule] = MODEL_RULES) -> list[str]:
    return sorted({r.cause for r in rules} | {UNKNOWN_CAUSE})


def log_grain_kpis(grain: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """KPIs that count join rows."""
    rows = F.sum("fact_rows")
    late = F.sum(F.col("is_late") * F.col("fact_rows"))
    failures = F.sum(F.when(failed(), F.col("fact_rows")).otherwise(0))
    return grain.groupBy(*by).agg(
        F.coalesce(rows, F.lit(0)).alias("total_orders"),
        F.coalesce(late * 100.0 / rows, F.lit(0.0)).alias("late_rate"),
        F.coalesce(failures * 100.0 / rows, F.lit(0.0)).alias("failed_rate"),
    )


def log_grain_causes(grain: DataFrame, joined: bool, rules: Sequence[Rule] = MODEL_RULES) -> DataFrame:
    """Rows per cause: of the cause table, or (``joined``) of the cause table joined back to the fact.

    Joined back on ``order_id``, each of an order's cause rows meets all its fact rows.
    """
    weight = F.col("fact_rows") if joined else F.lit(1)
    names = cause_names(rules)
    sums = grain.agg(
        *[F.coalesce(F.sum(F.col(f"{c}_rows") * weight), F.lit(0)).cast(PAIR_COUNT).alias(c) for c in names]
    )
    return sums.unpivot([], names, "cause", "cause_count").where(F.col("cause_count") > 0)


def log_grain_top_causes(grain: DataFrame, k: int = 10, rules: Sequence[Rule] = MODEL_RULES) -> DataFrame:
    return top(log_grain_causes(grain, joined=True, rules=rules), k)


def log_grain_by_warehouse(tables: Tables, grain: DataFrame) -> DataFrame:
    """KPIs per warehouse: an order adds its logs of that warehouse times its fleet rows.

    Orders without warehouse logs form the NULL warehouse.
    """
    visits = (
        tables["raw_warehouse_logs"]
        .where(F.col("order_id").isNotNull())
        .groupBy("order_id", "warehouse_id")
        .agg(F.count(F.lit(1)).alias("visits"))
    )
    dim = warehouse_dim(tables["dim_warehouses"]).drop(*(WAREHOUSE_DIM_COLUMNS - {"warehouse_name"}))
    rows = (
        grain.join(visits, "order_id", "left")
        .withColumn("fact_rows", F.coalesce("visits", F.lit(1)).cast(SIDE_COUNT) * F.col("fleet_rows").cast(SIDE_COUNT))
        .select("warehouse_id", "fact_rows", "is_late", "status")
    )
    # Sums per id first: the names are joined to one row per warehouse.
    sums = rows.groupBy("warehouse_id").agg(
        F.sum("fact_rows").alias("fact_rows"),
        F.sum(F.col("is_late") * F.col("fact_rows")).alias("late"),
        F.sum(F.when(failed(), F.col("fact_rows")).otherwise(0)).alias("failures"),
    )
    # Rates are quotients of whole numbers, taken as double.
    return (
        sums.join(dim, "warehouse_id", "left")
        .groupBy("warehouse_name")
        .agg(
            F.sum("fact_rows").alias("total_orders"),
            (F.sum("late") * 100.0 / F.sum("fact_rows")).alias("late_rate"),
            (F.sum("failures") * 100.0 / F.sum("fact_rows")).alias("failed_rate"),
        )
    )
