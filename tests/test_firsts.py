from shipcause.operators.firsts import first_row_per_key, first_value_per_key, worst_factor
from tests.fixtures import table


def factors(spark, *rows):
    return table(
        spark,
        "raw_external_factors",
        [{"order_id": 1, "traffic_condition": t, "recorded_at": at, **extra} for t, at, extra in rows],
    )


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_heaviest_traffic_then_earliest(spark):
    df = factors(
        spark,
        ("Moderate", "2025-01-01 08:00:00", {"event_type": "a"}),
        ("Heavy", "2025-01-01 10:00:00", {"event_type": "b"}),
        ("Heavy", "2025-01-01 09:00:00", {"event_type": "c"}),
    )
    for preset in ("model", "cli"):
        row = one(worst_factor(df, preset))
        assert (row.traffic_condition, row.event_type, row.traffic_score) == ("Heavy", "c", 2)


def test_missing_time_is_first_for_model_and_last_for_cli(spark):
    df = factors(spark, ("Heavy", "2025-01-01 09:00:00", {"event_type": "timed"}), ("Heavy", None, {"event_type": "none"}))
    assert one(worst_factor(df, "model")).event_type == "none"
    assert one(worst_factor(df, "cli")).event_type == "timed"


def test_score_ignores_case_only_in_model(spark):
    df = factors(spark, ("heavy", "2025-01-01 09:00:00", {}))
    assert one(worst_factor(df, "model")).traffic_score == 2
    assert one(worst_factor(df, "cli")).traffic_score == 0


def test_ties_go_by_position(spark):
    df = factors(
        spark, ("Heavy", "2025-01-01 09:00:00", {"event_type": "z"}), ("Heavy", "2025-01-01 09:00:00", {"event_type": "a"})
    )
    assert one(worst_factor(df, "model")).event_type == "z"


def test_first_row_whole_or_first_value_per_column(spark):
    logs = table(
        spark,
        "raw_warehouse_logs",
        [
            {"order_id": 1, "warehouse_id": 1, "notes": None},
            {"order_id": 1, "warehouse_id": 2, "notes": "slow"},
            {"order_id": None, "warehouse_id": 3},
        ],
    )
    row = one(first_row_per_key(logs, "order_id", ["load_seq"], ["warehouse_id", "notes"]))
    assert (row.warehouse_id, row.notes) == (1, None)
    row = one(first_value_per_key(logs, "order_id", "load_seq", ["warehouse_id", "notes"]))
    assert (row.warehouse_id, row.notes) == (1, "slow")


def test_a_hot_key_leaves_each_map_task_as_one_row(spark):
    """The reduction happens before the exchange, in both shapes."""
    logs = table(spark, "raw_warehouse_logs", [{"order_id": 1, "warehouse_id": i} for i in range(50)])
    for df in (
        first_row_per_key(logs, "order_id", ["load_seq"], ["warehouse_id"]),
        first_value_per_key(logs, "order_id", "load_seq", ["warehouse_id"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Exchange") < plan.index("partial_min")
        assert plan.count("Exchange") == 1
