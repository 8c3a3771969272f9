import datetime as dt

import pytest
from pyspark.sql import functions as F

from shipcause.fixed import TABLE_FILES
from shipcause.functions.dates import epoch_nanos, hours_between, normalize_dates, second_text, strict_timestamp
from shipcause.functions.values import leading_double, null_if_missing, try_double
from shipcause.operators import quality
from shipcause.plans.model import open_model, refresh
from shipcause.sources.presence import require_sources, require_tables, source_report
from shipcause.sources.query import run_query, run_select
from shipcause.sources.store import save_as_table, shared_folder, write_table
from shipcause.sources.tables import read_csv
from tests.fixtures import tables

# Invented rows: a leading zero and a plus sign have to stay.
WAREHOUSES = """warehouse_id,warehouse_name,state,city,pincode,capacity,manager_name,contact_phone,created_at
1,Warehouse 1,Northland,Harbour,001234,100,First Person,5550100001,2021-02-03 04:05:06
2,Warehouse 2,Southland,Hilltop,098765,200,Second Person,+15550100002,2022-03-04 05:06:07
"""

FILES = {
    "orders.csv": """order_id,client_id,customer_name,city,state,status,payment_mode,amount,failure_reason,order_date,promised_delivery_date,actual_delivery_date,created_at
1,1,Ann,Pune,MH,Failed,COD,10.5,Stockout,2025-08-01 09:00:00,2025-08-02 09:00:00,2025-08-02 12:00:00,2025-08-01 09:00:00
2,1,Bob,Pune,MH,Delivered,COD,bad,,2025-08-03 09:00:00,2025-08-04 09:00:00,,2025-08-03 09:00:00
""",
    "fleet_logs.csv": "order_id,driver_id,vehicle_number,route_code,gps_delay_notes,departure_time,arrival_time,created_at\n"
    "1,7,V1,R1,Heavy congestion,2025-08-01 10:00:00,2025-08-01 12:30:00,2025-08-01 10:00:00\n",
    "warehouse_logs.csv": "order_id,warehouse_id,picking_start,picking_end,dispatch_time,notes\n"
    '1,2,2025-08-01 09:00:00,2025-08-01 09:31:00,2025-08-01 10:00:00,"Slow, with ""quotes"""\n',
    "external_factors.csv": "order_id,traffic_condition,weather_condition,event_type,recorded_at\n2,Clear,Rain,None,2025-08-03 10:00:00\n",
    "feedback.csv": 'order_id,rating,sentiment,feedback_text,created_at\n2,4,Positive,"two\nlines, no update",2025-08-05 10:00:00\n',
    "warehouses.csv": WAREHOUSES,
    "clients.csv": "client_id,client_name,created_at\n1,Example Ltd,2024-01-01 00:00:00\n",
    "drivers.csv": "driver_id,created_at\n7,2024-01-01 00:00:00\n",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_csv_columns_stay_text(spark, folder):
    rows = read_csv(spark, f"{folder}/warehouses.csv").orderBy("load_seq").collect()
    assert [(r.pincode, r.contact_phone) for r in rows] == [("001234", "5550100001"), ("098765", "+15550100002")]


def test_quotes_and_line_breaks(spark, folder):
    assert read_csv(spark, f"{folder}/feedback.csv").first().feedback_text == "two\nlines, no update"
    assert read_csv(spark, f"{folder}/warehouse_logs.csv").first().notes == 'Slow, with "quotes"'


def test_refresh_and_open(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("model"))
    for _ in range(2):  # the second time replaces everything
        model = refresh(spark, folder, out)
    counts = {r.table_name: r.row_count for r in model.load_stats().collect()}
    assert counts == dict.fromkeys(TABLE_FILES, 1) | {"raw_orders": 2, "dim_warehouses": 2}
    assert {r.metric: r.value for r in model.model_stats().collect()} == {
        "fact_order_analysis_rows": 2, "fact_order_causes_rows": 6, "unique_causes": 6,
    }
    saved = open_model(spark, out)
    causes = {(r.order_id, r.cause) for r in saved.causes.collect()}
    assert causes == {
        (1, "stockout"), (1, "warehouse_delay"), (1, "traffic"), (1, "late_delivery"), (2, "weather"), (2, "poor_comm"),
    }
    row = saved.fact.where("order_id = 2").first()
    assert (row.amount, row.event_type, row.feedback_text_concat) == (0.0, None, "two\nlines, no update")
    assert row.order_month == "2025-08" and saved.fact.schema["order_month"].dataType.typeName() == "string"
    assert spark.sql("select count(*) from v_cause_summary").first()[0] == 6
    require_tables(spark, ["fact_order_analysis", "fact_order_causes", "v_external_best", "v_feedback_summary"])


def test_missing_sources(spark, folder, tmp_path):
    assert source_report(spark, folder).where("present").count() == 8
    (tmp_path / "clients.csv").unlink()
    (tmp_path / "orders.csv").unlink()
    with pytest.raises(FileNotFoundError, match="clients.csv, orders.csv"):
        require_sources(spark, folder)
    with pytest.raises(FileNotFoundError, match="not found"):
        require_sources(spark, folder + "/nowhere")
    with pytest.raises(FileNotFoundError, match="no_such_table"):
        require_tables(spark, ["no_such_table"])


def test_missing_tokens_match_exactly(spark):
    df = spark.createDataFrame([("NA",), ("None",), ("",), ("none",), (" None",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(null_if_missing("v")).collect()] == [None, None, None, "none", " None", "x", None]


def test_number_casts(spark):
    texts = ["4", "4x", "abc", "-1.5e2", " 7", ".5", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(leading_double("v")).collect()] == [4.0, 4.0, 0.0, -150.0, 7.0, 0.5, 0.0, None]
    assert [r[0] for r in df.select(try_double("v")).collect()] == [4.0, None, None, -150.0, 7.0, 0.5, None, None]


def test_dates(spark):
    df = spark.createDataFrame([("2025-01-02 03:04:05.678", "x"), ("nonsense", "x"), (None, "x")], "d string, other string")
    out = normalize_dates(df, ["d", "absent"])
    assert out.columns == ["d", "other"]
    assert [r.d for r in out.collect()] == [dt.datetime(2025, 1, 2, 3, 4, 5), None, None]
    assert out.select(second_text("d")).first()[0] == "2025-01-02 03:04:05"
    other = spark.createDataFrame([("02/01/2025 03:04",)], "d string")
    assert normalize_dates(other, ["d"], ("dd/MM/yyyy HH:mm",)).first().d == dt.datetime(2025, 1, 2, 3, 4)


def test_dates_do_not_depend_on_the_session_time_zone(spark):
    """02:30 does not exist on that day in New York, and delays span the change of the clocks."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2025-03-09 02:30:00.5", "09/03/2025 02:30", "2025-03-10 02:30:00")], "a string, b string, c string")
        out = normalize_dates(df, ["a", "b", "c"], ("dd/MM/yyyy HH:mm",))
        row = out.select("a", "b", second_text("a").alias("text"), hours_between("a", "c").alias("hours")).first()
        gap = dt.datetime(2025, 3, 9, 2, 30)
        assert tuple(row) == (gap, gap, "2025-03-09 02:30:00", 24.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_epoch_nanoseconds_only_when_nothing_else_parses(spark):
    nanos = "1735689600000000000"
    alone = spark.createDataFrame([(nanos,), (None,)], "d string")
    assert [r.d for r in normalize_dates(alone, ["d"]).collect()] == [dt.datetime(2025, 1, 1), None]
    mixed = spark.createDataFrame([(nanos,), ("2025-01-01 00:00:00",)], "d string")
    assert [r.d for r in normalize_dates(mixed, ["d"]).collect()] == [None, dt.datetime(2025, 1, 1)]
    assert spark.range(1).select(epoch_nanos(F.lit("-1"))).first()[0] == dt.datetime(1969, 12, 31, 23, 59, 59, 999999)


def test_strict_dates_fail(spark):
    df = spark.createDataFrame([("nonsense",)], "d string")
    with pytest.raises(Exception, match="nonsense"):
        df.select(strict_timestamp("d")).collect()


def test_queries(spark):
    assert run_query(spark, "select ? + ? as n", [1, 2]).first().n == 3
    assert run_select(spark, "  Select 1 as n").rows.first().n == 1
    assert run_select(spark, "WITH x AS (SELECT 1) SELECT * FROM x").error == "Only SELECT queries are allowed."
    assert run_select(spark, "drop table t").rows is None
    assert run_select(spark, "select nothing from nowhere").error.startswith("Query failed: ")
    assert run_select(spark, "select 1; select 2").error.startswith("Query failed: ")


def test_sinks_replace(spark, tmp_path):
    for n in (3, 2):
        assert write_table(spark.range(n).toDF("n"), str(tmp_path / "t")).count() == n
        assert save_as_table(spark.range(n).toDF("n"), "replaced").count() == n
    months = spark.createDataFrame([("2025-01", 1), ("2025-02", 2), (None, 3)], "order_month string, n int")
    back = write_table(months, str(tmp_path / "m"), "order_month")
    assert sorted(r.n for r in back.collect()) == [1, 2, 3]
    assert "order_month" in back.where("order_month = '2025-01'")._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# ---- data checks ------------------------------------------------------------------


def test_quality(spark):
    t = tables(
        spark,
        raw_orders=[{"order_id": 1, "client_id": 1}, {"order_id": 1, "client_id": 2}, {"order_id": None}],
        dim_clients=[{"client_id": 1}],
        raw_feedback=[{"order_id": 9}, {"order_id": 9}, {"order_id": 1}],
    )
    nulls = {r.table_name: r.null_keys for r in quality.null_keys(t).collect()}
    assert nulls["raw_orders"] == 1 and nulls["raw_feedback"] == 0
    assert [tuple(r) for r in quality.duplicate_keys(t["raw_orders"], "order_id").collect()] == [(1, 2)]
    orphans = {(r.table_name, r.key_name): (r.orphan_keys, r.orphan_rows) for r in quality.orphan_keys(t).collect()}
    assert orphans["raw_orders", "client_id"] == (1, 1)
    assert orphans["raw_feedback", "order_id"] == (1, 2)
    raw = spark.createDataFrame([("2025-01-01", "x"), ("oops", "NA")], "order_date string, created_at string")
    assert {r.column_name: r.invalid_dates for r in quality.invalid_dates(raw, "raw_orders").collect()} == {
        "order_date": 1, "created_at": 1,
    }


def test_schema_report(spark):
    t = tables(spark)
    assert quality.schema_report(t).count() == 0
    t["raw_feedback"] = t["raw_feedback"].drop("rating").withColumn("order_id", F.lit("1"))
    del t["dim_drivers"]
    assert quality.schema_problems(t) == [
        ("raw_feedback", "order_id", "string instead of bigint"),
        ("raw_feedback", "rating", "missing"),
        ("dim_drivers", "", "table missing"),
    ]
