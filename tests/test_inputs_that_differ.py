"""Inputs that do not look like the usual ones."""

import pytest

from shipcause.functions.dates import normalize_dates
from shipcause.operators import quality, scopes
from shipcause.operators.causes import MODEL_RULES, Rule, TEXT, explode_causes, infer_causes
from shipcause.operators.fact import build_fact, fact_with_causes
from shipcause.operators.feedback import feedback_text_rows
from shipcause.plans.model import save_model
from shipcause.plans.scenarios import compare_cities
from shipcause.sources.presence import source_report
from shipcause.sources.query import iterate_select, preview_select, run_select
from shipcause.sources.store import new_folder, shared_folder
from tests.fixtures import tables


def order(i=1, **more):
    return {"order_id": i, "client_id": 1, "city": "Pune", "order_date": "2025-08-01 00:00:00", **more}


def test_patterns_ignore_case_beyond_ascii(spark):
    df = spark.createDataFrame([("ÉCOLE SA",), ("ecole",), (None,)], "name string")
    assert [r.name for r in df.where(scopes.matches("name", "école")).collect()] == ["ÉCOLE SA"]


@pytest.mark.parametrize(("event", "found"), [("\t", False), ("  \n", False), ("", False), ("Strike", True), (" x ", True)])
def test_blank_events(spark, event, found):
    t = tables(spark, raw_orders=[order()], raw_external_factors=[{"order_id": 1, "event_type": event}])
    assert ("event" in fact_with_causes(t, "causes").first().causes) is found


def test_large_driver_ids(spark):
    t = tables(spark, raw_orders=[order()], raw_fleet_logs=[{"order_id": 1, "driver_id": 3_000_000_000}])
    assert build_fact(t, "cli").first().driver_id == 3_000_000_000


@pytest.mark.parametrize(
    "sql",
    [
        "select reflect('java.lang.System', 'nanoTime')", "select java_method('java.lang.System', 'nanoTime')",
        "select try_reflect('java.lang.System', 'nanoTime')", "select id from range(3) where id < (select max(id) from range(2) where length(reflect('java.lang.System', 'getProperty', 'os.name')) > 0)",
        "select * from parquet.`{path}`", "select x.id from (select 1 as id) x, parquet.`{path}` y", "select * from `parquet`.`{path}`",
        "select x.id from (select 1 as id) x join parquet.`{path}` y on x.id = y.id", "select 1 where exists (select * from parquet.`{path}`)",
        "select * from (with t as (select * from parquet.`{path}`) select * from t)", "select transform(id) using 'cat' as (x string) from range(3)",
        "select 1 in (select id from parquet.`{path}`)", "select * from registered r, lateral (select * from parquet.`{path}` p where p.id = r.id)",
        "select * from text.`{path}`", "drop table x",
    ],
)
def test_ad_hoc_queries_stay_within_the_tables(spark, tmp_path, sql):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("registered")
    result = run_select(spark, sql.replace("{path}", path))
    assert result.rows is None and result.error
    assert preview_select(spark, sql.replace("{path}", path)).error


@pytest.mark.parametrize(
    "sql",
    [
        "select 1 as reflected", "select * from registered r join stored s using (id)", "select count(*) from registered where id in (select id from stored)",
        "select * from (with t as (select id, row_number() over (order by id) n from registered) select * from t where n > 1 union select 7, 8)",
        "select id, x from registered lateral view explode(array(1, 2)) as x limit 2 offset 1", "select distinct id % 2 from stored order by 1",
        "select * from (select id % 2 a, id b from stored) pivot (sum(b) for a in (0, 1))", "select id, count(*) from registered group by cube(id) having count(*) > 0",
        "select * from values (1, 2), (3, 4) as t(a, b)", "select * from registered r, lateral (select max(id) from stored s where s.id <= r.id)",
    ],
)
def test_ad_hoc_queries_over_tables_and_views(spark, tmp_path, sql):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView("registered")
    spark.range(4).write.mode("overwrite").saveAsTable("stored")
    shown = preview_select(spark, sql)
    assert shown.error is None and shown.rows


def test_ad_hoc_queries_show_errors_and_what_is_left(spark):
    shown = preview_select(spark, "select cast('x' as int) as n")
    assert shown.rows == [] and shown.error.startswith("Query failed")
    shown = preview_select(spark, "select id from range(1500) order by id", limit=1499)
    assert [r.id for r in shown.rows] == list(range(1499)) and shown.more
    assert not preview_select(spark, "select id from range(7)", limit=7).more
    assert [r.id for r in iterate_select(spark, "select id from range(1500) order by id")] == list(range(1500))
    with pytest.raises(ValueError, match="Only SELECT"):
        iterate_select(spark, "show tables")


def test_files_in_subfolders_are_not_the_sources(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "orders.csv").write_text("order_id\n1\n")
    (tmp_path / "clients.csv").write_text("client_id\n1\n")
    (tmp_path / "drivers.csv").mkdir()
    (tmp_path / "drivers.csv" / "part-0.csv").write_text("driver_id\n1\n")
    for folder in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        found = {r.file_name for r in source_report(spark, folder).where("present").collect()}
        assert found == {"clients.csv", "drivers.csv"}


def test_rows_without_key_are_no_duplicates(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in quality.duplicate_keys(df, "k").collect()] == [(1, 2)]


def test_a_city_compared_with_itself(spark):
    fact = build_fact(tables(spark, raw_orders=[order()]), "cli")
    from shipcause.operators.causes import infer_causes_cli

    assert compare_cities(infer_causes_cli(fact), "Pune", "Pune", "2025-08-01", "2025-08-31").count() == 2


def test_compact_dates(spark):
    rows = [("20250801", "08/01/2025 10:00"), ("20250801103000", None), ("202508011030", "bad")]
    got = normalize_dates(spark.createDataFrame(rows, "a string, b string"), ["a", "b"], ("MM/dd/yyyy HH:mm",)).collect()
    assert [str(r.a) for r in got] == ["2025-08-01 00:00:00", "2025-08-01 10:30:00", "2025-08-01 10:30:00"]
    assert [str(r.b) for r in got] == ["2025-08-01 10:00:00", "None", "None"]


def test_own_rules_see_feedback(spark):
    own = [Rule("rude", "contains", TEXT, "rude")]
    t = tables(spark, raw_orders=[order()], raw_feedback=[{"order_id": 1, "feedback_text": "A RUDE driver"}])
    assert fact_with_causes(t, "causes", rules=own).first().causes == ["rude"]
    plain = build_fact(t, "model", ["order_id", "failure_reason", "gps_delay_notes", "warehouse_notes", "feedback_text_concat"])
    assert infer_causes(plain, own).first().causes == ["rude"]
    other = build_fact(t, "model", ["order_id", "failure_reason", "gps_delay_notes", "warehouse_notes", "feedback_needles"], MODEL_RULES)
    with pytest.raises(ValueError, match="rude"):
        infer_causes(other, own)


def test_causes_from_a_saved_fact(spark):
    t = tables(spark, raw_orders=[order(1), order(2)], raw_feedback=[{"order_id": 1, "feedback_text": "no update, out of STOCK"}])
    saved = save_model(t, new_folder(spark, "model"))
    again = explode_causes(infer_causes(saved.fact.drop("causes")))
    key = lambda df: sorted((r.order_id, r.cause) for r in df.collect())
    assert key(again) == key(saved.causes) and (1, "poor_comm") in key(again)
    assert feedback_text_rows(t["raw_feedback"]).count() == 1


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    for values in ({}, {"spark.master": "spark://a:7077"}, {"spark.master": "local-cluster[2,1,1024]"}):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Session(**values))
    assert shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
