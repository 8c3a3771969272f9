import pytest

from shipcause.fixed import MODEL_ACTIONS
from shipcause.operators.causes import (
    MODEL_RULES,
    Rule,
    distinct_recommendations,
    explode_causes,
    infer_causes,
)
from shipcause.operators.fact import build_fact, fact_with_causes
from shipcause.operators.fanout import log_grain, log_grain_causes, log_grain_kpis, log_grain_top_causes
from shipcause.schemas import FACT_COLUMNS
from tests.fixtures import tables

DAY = "2025-08-01 00:00:00"


def order(**columns):
    return {"order_id": 1, "promised_delivery_date": DAY, "actual_delivery_date": DAY, "order_date": DAY} | columns


def causes(spark, preset="model", **rows):
    rows.setdefault("raw_orders", [order()])
    return fact_with_causes(tables(spark, **rows), "causes", preset=preset).first().causes


@pytest.mark.parametrize(
    "promised,actual,model,cli,late",
    [
        (DAY, None, 0.0, 0.0, False),
        (None, DAY, None, 0.0, False),
        (DAY, "2025-08-01 00:00:36", 0.01, 0.01, False),
        (DAY, "2025-08-01 00:00:37", 37 / 3600, 37 / 3600, True),
        (DAY, "2025-07-31 12:00:00", -12.0, -12.0, False),
    ],
)
def test_delay(spark, promised, actual, model, cli, late):
    t = tables(spark, raw_orders=[order(promised_delivery_date=promised, actual_delivery_date=actual)])
    row = build_fact(t, "model").first()
    assert row.delay_hours == (None if model is None else pytest.approx(model)) and row.is_late == int(late)
    row = build_fact(t, "cli").first()
    assert row.delay_hours == pytest.approx(cli) and row.is_late is late


def test_durations_may_be_negative(spark):
    t = tables(
        spark,
        raw_orders=[order()],
        raw_fleet_logs=[{"order_id": 1, "driver_id": 7, "departure_time": "2025-08-01 12:00:00", "arrival_time": DAY}],
    )
    assert build_fact(t, "model").first().transit_hours == -12.0
    assert build_fact(t, "cli").first().transit_hours == -12.0


def test_fact_columns(spark):
    t = tables(spark, raw_orders=[order()])
    assert build_fact(t, "model", FACT_COLUMNS).columns == FACT_COLUMNS
    with pytest.raises(ValueError):
        build_fact(t, "other")


def test_dimensions_and_text_in_the_fact(spark):
    t = tables(
        spark,
        raw_orders=[order(client_id=5, amount=1.5)],
        raw_warehouse_logs=[{"order_id": 1, "warehouse_id": 2, "notes": "n"}],
        raw_feedback=[{"order_id": 1, "feedback_text": "A"}, {"order_id": 1, "feedback_text": "B"}],
        dim_warehouses=[{"warehouse_id": 2, "warehouse_name": "Warehouse 2", "city": "Pune", "state": "MH"}],
        dim_clients=[{"client_id": 5, "client_name": "Five"}],
    )
    row = build_fact(t, "model").first()
    assert (row.client_name, row.warehouse_name, row.warehouse_city, row.warehouse_notes, row.amount) == (
        "Five", "Warehouse 2", "Pune", "n", 1.5,
    )
    assert row.feedback_text_concat == "a || b"
    row = build_fact(t, "cli").first()
    assert (row.client_name, row.warehouse_name, row.warehouse_state, row.notes) == ("Five", "Warehouse 2", "MH", "n")


def test_suffix_for_columns_of_the_same_name(spark):
    fact = build_fact(tables(spark, raw_orders=[order()]), "cli")
    assert "created_at" in fact.columns and "created_at_fleet" in fact.columns


@pytest.mark.parametrize("minutes,expected", [(30, False), (31, True)])
def test_picking_limit(spark, minutes, expected):
    log = {"order_id": 1, "picking_start": DAY, "picking_end": f"2025-08-01 00:{minutes}:00"}
    for preset in ("model", "cli"):
        assert ("warehouse_delay" in causes(spark, preset, raw_warehouse_logs=[log])) is expected


@pytest.mark.parametrize("minutes,expected", [(45, False), (46, True)])
def test_dispatch_limit(spark, minutes, expected):
    log = {"order_id": 1, "picking_end": DAY, "dispatch_time": f"2025-08-01 00:{minutes}:00"}
    for preset in ("model", "cli"):
        assert ("dispatch_lag" in causes(spark, preset, raw_warehouse_logs=[log])) is expected


def factor(**columns):
    return [{"order_id": 1, "recorded_at": DAY} | columns]


def test_weather_matches_exactly(spark):
    for preset in ("model", "cli"):
        assert "weather" in causes(spark, preset, raw_external_factors=factor(weather_condition="Fog"))
        assert "weather" not in causes(spark, preset, raw_external_factors=factor(weather_condition="rain"))


@pytest.mark.parametrize("event,model,cli", [("", False, False), ("  ", False, True), (None, False, False), ("Strike", True, True)])
def test_event(spark, event, model, cli):
    assert ("event" in causes(spark, "model", raw_external_factors=factor(event_type=event))) is model
    assert ("event" in causes(spark, "cli", raw_external_factors=factor(event_type=event))) is cli


def test_late_by_feedback_only_in_cli(spark):
    said = [{"order_id": 1, "feedback_text": "delayed"}]
    assert causes(spark, "cli", raw_feedback=said) == ["late_delivery"]
    assert causes(spark, "model", raw_feedback=said) == ["unknown"]


def test_out_of_stock_in_feedback(spark):
    said = [{"order_id": 1, "feedback_text": "out of stock"}]
    assert causes(spark, "cli", raw_feedback=said) == ["stock_issue"]
    assert causes(spark, "model", raw_feedback=said) == ["stockout"]


def test_all_texts_of_an_order_count(spark):
    found = causes(
        spark,
        raw_orders=[order(failure_reason="Wrong ADDRESS")],
        raw_fleet_logs=[{"order_id": 1, "gps_delay_notes": "Breakdown, congestion"}],
        raw_warehouse_logs=[{"order_id": 1, "notes": "Slow; stock low"}],
        raw_feedback=[{"order_id": 1, "feedback_text": "no UPDATE"}],
    )
    assert found == ["address_issue", "poor_comm", "stockout", "traffic", "vehicle_issue", "warehouse_delay"]


def test_no_signal(spark):
    t = tables(spark, raw_orders=[order()])
    model = explode_causes(fact_with_causes(t, "order_id", "causes")).first()
    assert (model.cause, model.recommendation) == ("unknown", "Inspect order logs for missing context.")
    cli = fact_with_causes(t, "order_id", "causes", preset="cli")
    assert cli.first().causes == []
    assert explode_causes(cli).count() == 0
    assert explode_causes(cli, keep_empty=True).first().cause is None


def test_own_rules_and_actions(spark):
    t = tables(spark, raw_orders=[order(failure_reason="lost parcel")])
    rules = [*MODEL_RULES, Rule("lost", "contains", "text", "lost")]
    rows = explode_causes(fact_with_causes(t, "order_id", "causes", rules=rules), MODEL_ACTIONS)
    assert [(r.cause, r.recommendation) for r in rows.collect()] == [("lost", "Investigate further.")]
    with pytest.raises(ValueError):
        infer_causes(rows.withColumnRenamed("cause", "c"), [Rule("x", "sounds like", "c")], ["c"])


def test_distinct_recommendations(spark):
    t = tables(
        spark,
        raw_orders=[order(), order(order_id=2), order(order_id=3)],
        raw_external_factors=[{"order_id": i, "traffic_condition": "Heavy"} for i in (1, 2)],
    )
    rows = distinct_recommendations(explode_causes(fact_with_causes(t, "order_id", "causes"))).collect()
    assert [(r.cause, r.recommendation) for r in rows] == [("traffic", MODEL_ACTIONS["traffic"])]


def test_log_grain_counts_pairs(spark):
    """Two warehouse logs and three fleet logs, one cause in every pair: 6 fact rows, 6 cause rows, 36 joined."""
    t = tables(
        spark,
        raw_orders=[order(failure_reason="address")],
        raw_warehouse_logs=[{"order_id": 1}, {"order_id": 1}],
        raw_fleet_logs=[{"order_id": 1}] * 3,
    )
    grain = log_grain(t)
    assert grain.first().fact_rows == 6
    assert [tuple(r) for r in log_grain_causes(grain, joined=False).collect()] == [("address_issue", 6)]
    assert [tuple(r) for r in log_grain_top_causes(grain).collect()] == [("address_issue", 36)]
    assert log_grain_kpis(grain).first().total_orders == 6


def test_log_grain_combines_both_sides(spark):
    """A cause on one of two warehouse logs or on one of three fleet logs: 6 - 1 * 2 pairs."""
    t = tables(
        spark,
        raw_orders=[order(), order(order_id=2)],
        raw_warehouse_logs=[{"order_id": 1, "notes": "wrong address"}, {"order_id": 1}],
        raw_fleet_logs=[{"order_id": 1, "gps_delay_notes": "address"}, {"order_id": 1}, {"order_id": 1}],
    )
    counts = {r.cause: r.cause_count for r in log_grain_causes(log_grain(t), joined=False).collect()}
    assert counts == {"address_issue": 4, "unknown": 2 + 1}
