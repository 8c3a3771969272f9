"""The order-level fact: orders joined with everything that is known about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import FEEDBACK_TAGS, LATE_AFTER_MICROS
from shipcause.functions.dates import hours_between, micros_between, minutes_between, month_text, strict_timestamp
from shipcause.functions.values import as_double
from shipcause.operators.causes import (
    CLI_RULES,
    CLI_TEXT_FIELDS,
    MODEL_RULES,
    MODEL_TEXT_FIELDS,
    Rule,
    infer_causes,
    infer_causes_cli,
    needles,
    rule_columns,
)
from shipcause.operators.feedback import feedback_summary_cli, feedback_summary_model, feedback_text
from shipcause.operators.firsts import first_row_per_key, first_value_per_key, worst_factor
from shipcause.operators.spread import join_dimension, with_key
from shipcause.schemas import FACT_COLUMNS, SEQ

Tables = Mapping[str, DataFrame]

MONTH = "order_month"

# Fact column -> the columns of a log row that it is made of, in the model preset.
STOCK_SOURCES = {
    "warehouse_id": ["warehouse_id"],
    "warehouse_name": ["warehouse_id"],
    "warehouse_city": ["warehouse_id"],
    "warehouse_state": ["warehouse_id"],
    "warehouse_notes": ["notes"],
    "picking_minutes": ["picking_start", "picking_end"],
    "dispatch_lag_minutes": ["picking_end", "dispatch_time"],
}
FLEET_SOURCES = {
    "driver_id": ["driver_id"],
    "vehicle_number": ["vehicle_number"],
    "route_code": ["route_code"],
    "gps_delay_notes": ["gps_delay_notes"],
    "transit_hours": ["departure_time", "arrival_time"],
}
WAREHOUSE_DIM_COLUMNS = {"warehouse_name", "warehouse_city", "warehouse_state"}


FACTOR_COLUMNS = {"traffic_condition", "weather_condition", "event_type", "traffic_score"}
FEEDBACK_COLUMNS = {"feedback_rating_avg", "feedback_sentiment_top", "feedback_needles", "feedback_tags"}


def picking_minutes() -> Column:
    return minutes_between("picking_start", "picking_end")


def dispatch_lag_minutes() -> Column:
    return minutes_between("picking_end", "dispatch_time")


def transit_hours() -> Column:
    return hours_between("departure_time", "arrival_time")


def delay_columns(preset: str = "model") -> dict[str, Column]:
    """``delay_hours`` and ``is_late``.

    ``model``: an order without actual date is on time, one without promised date has no delay value;
    ``is_late`` is 0/1. ``cli``: any missing date gives delay 0; ``is_late`` is boolean.
    """
    promised = F.col("promised_delivery_date")
    actual = F.col("actual_delivery_date")
    if preset == "model":
        actual = F.coalesce(actual, promised)
    late = F.coalesce(micros_between(promised, actual) > LATE_AFTER_MICROS, F.lit(False))
    delay = hours_between(promised, actual)
    if preset == "model":
        return {"delay_hours": delay, "is_late": late.cast("int")}
    return {"delay_hours": F.coalesce(delay, F.lit(0.0)), "is_late": late}


def warehouse_dim(dim: DataFrame) -> DataFrame:
    return dim.select(
        "warehouse_id",
        "warehouse_name",
        F.col("city").alias("warehouse_city"),
        F.col("state").alias("warehouse_state"),
    )


def client_dim(dim: DataFrame) -> DataFrame:
    return dim.select("client_id", "client_name")


def build_fact(
    tables: Tables,
    preset: str = "model",
    columns: Sequence[str] | None = None,
    rules: Sequence[Rule] = MODEL_RULES,
    tags: Mapping[str, str] = FEEDBACK_TAGS,
) -> DataFrame:
    """One row per order.

    ``preset="model"`` takes the first log row of an order whole, ``preset="cli"`` the first value of each
    log column. Each log is reduced to one row per order before it is joined, and all these joins
    share the partitioning on ``order_id``. Dimensions are joined to the narrowest side that holds their
    key; Spark broadcasts a dimension when its measured size allows, and otherwise the rows of common clients and
    warehouses are spread out (``spread.join_dimension``). Orders without id are set aside before the joins.
    ``columns`` names what the caller reads: joins that serve none of them are not made. Dimension keys
    are unique by contract (``quality.duplicate_keys`` reports breaches).
    """
    if preset == "model":
        return _model_fact(tables, columns, rules)
    if preset == "cli":
        return _cli_fact(tables, columns, dict(tags))
    raise ValueError(f"unknown preset {preset!r}")


def _model_fact(tables: Tables, columns: Sequence[str] | None, rules: Sequence[Rule]) -> DataFrame:
    wanted = list(columns) if columns else [*FACT_COLUMNS, MONTH, "feedback_needles"]
    need = set(wanted)

    # Only what is read of a log row goes through its shuffle.
    reduced = []
    if columns_read := _sources(STOCK_SOURCES, need):
        logs = tables["raw_warehouse_logs"]
        stock = first_row_per_key(logs, "order_id", [SEQ], columns_read)
        if need & WAREHOUSE_DIM_COLUMNS:
            stock = join_dimension(stock, warehouse_dim(tables["dim_warehouses"]), "warehouse_id", logs)
        reduced.append(stock.withColumnsRenamed({"notes": "warehouse_notes"}))
    if columns_read := _sources(FLEET_SOURCES, need):
        reduced.append(first_row_per_key(tables["raw_fleet_logs"], "order_id", [SEQ], columns_read))
    if need & FACTOR_COLUMNS:
        reduced.append(worst_factor(tables["raw_external_factors"], "model"))
    if need & FEEDBACK_COLUMNS:
        reduced.append(feedback_summary_model(tables["raw_feedback"], needles(rules)))
    if "feedback_text_concat" in need:
        reduced.append(feedback_text(tables["raw_feedback"]))

    orders = _with_reduced(tables["raw_orders"], reduced)
    if "client_name" in need:
        orders = join_dimension(orders, client_dim(tables["dim_clients"]), "client_id", tables["raw_orders"])

    derived = {
        "amount": as_double(tables["raw_orders"], "amount"),
        **delay_columns("model"),
        MONTH: month_text("order_date"),
        "transit_hours": transit_hours(),
        "picking_minutes": picking_minutes(),
        "dispatch_lag_minutes": dispatch_lag_minutes(),
    }
    return orders.select(*[derived[c].alias(c) if c in derived else c for c in wanted])


def _with_reduced(orders: DataFrame, reduced: Sequence[DataFrame]) -> DataFrame:
    """``orders`` left-joined with frames of one row per order."""
    return with_key(orders, "order_id", lambda rows: reduce(lambda left, right: left.join(right, "order_id", "left"), reduced, rows))


def _sources(sources: Mapping[str, list[str]], need: set[str]) -> list[str]:
    return list(dict.fromkeys(c for name, parts in sources.items() if name in need for c in parts))


def _cli_fact(tables: Tables, columns: Sequence[str] | None, tags: dict[str, str]) -> DataFrame:
    orders = tables["raw_orders"].withColumns(
        {
            "amount": F.col("amount").cast("double"),
            **{c: strict_timestamp(c) for c in ("order_date", "promised_delivery_date", "actual_delivery_date")},
        }
    )
    need = set(columns) if columns else None

    def read(names: set[str]) -> bool:
        return need is None or bool(need & names)

    reduced = []
    logs = tables["raw_warehouse_logs"]
    stock = logs.withColumns({"picking_minutes": picking_minutes(), "dispatch_lag_minutes": dispatch_lag_minutes()})
    taken = set(orders.columns)
    stock = _first_values(stock, taken, "_wh", need, {"warehouse_id"} if read(WAREHOUSE_DIM_COLUMNS) else set())
    if stock is not None:
        if read(WAREHOUSE_DIM_COLUMNS):
            stock = join_dimension(stock, warehouse_dim(tables["dim_warehouses"]), "warehouse_id", logs)
        reduced.append(stock)
        taken |= set(stock.columns)

    fleet = tables["raw_fleet_logs"].withColumns(
        {"driver_id": F.col("driver_id").cast("bigint"), "transit_hours": transit_hours()}
    )
    fleet = _first_values(fleet, taken, "_fleet", need)
    if fleet is not None:
        reduced.append(fleet)

    if read(FACTOR_COLUMNS):
        reduced.append(worst_factor(tables["raw_external_factors"], "cli"))
    if read(FEEDBACK_COLUMNS):
        reduced.append(feedback_summary_cli(tables["raw_feedback"], tags))
    fact = _with_reduced(orders, reduced)
    if read({"client_name"}):
        fact = join_dimension(fact, client_dim(tables["dim_clients"]), "client_id", tables["raw_orders"])
    fact = fact.withColumns(delay_columns("cli"))
    return fact.select(*columns) if columns else fact


def _first_values(
    log: DataFrame, taken: set[str], suffix: str, need: set[str] | None, also: set[str] = frozenset()
) -> DataFrame | None:
    """The first values of the log columns that are read, renamed where the name is ``taken``; None for none."""
    names = {c: c + suffix if c in taken else c for c in log.columns if c not in ("order_id", SEQ)}
    names = {c: n for c, n in names.items() if need is None or n in need or c in also}
    if not names:
        return None
    return first_value_per_key(log, "order_id", SEQ, list(names)).withColumnsRenamed(names)


def fact_with_causes(
    tables: Tables, *columns: str, preset: str = "model", rules: Sequence[Rule] | None = None
) -> DataFrame:
    """The named columns of the fact, among them ``causes`` where asked for, at the cost of just these."""
    if rules is None:
        rules = MODEL_RULES if preset == "model" else CLI_RULES
    if "causes" not in columns:
        return build_fact(tables, preset, columns, rules)
    if preset == "model":
        reads = [*rule_columns(rules, MODEL_TEXT_FIELDS), "feedback_needles"]
        infer = infer_causes
    else:
        reads = rule_columns(rules, CLI_TEXT_FIELDS)
        infer = infer_causes_cli
    plain = [c for c in columns if c != "causes"]
    return infer(build_fact(tables, preset, list(dict.fromkeys([*plain, *reads])), rules), rules).select(*columns)
