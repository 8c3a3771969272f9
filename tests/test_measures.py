import datetime as dt

import pytest
from pyspark.sql import functions as F

from shipcause.functions.dates import last_day_seen, ordered_days, past_week, previous_month
from shipcause.operators import measures, scopes
from shipcause.operators.causes import explode_causes, infer_causes
from shipcause.operators.fact import build_fact, fact_with_causes
from shipcause.operators.insights import insights, insights_by, onboarding, projected_late
from shipcause.plans.questions import route_questions
from shipcause.plans.templates import explore, run_template
from tests.fixtures import tables


@pytest.fixture(scope="module")
def small(spark):
    """Six orders of two cities; promised at order time, late by the given hours."""
    def order(i, city, day, hours, **more):
        return {
            "order_id": i, "city": city, "client_id": i % 2, "order_date": f"{day} 10:00:00",
            "promised_delivery_date": f"{day} 10:00:00", "actual_delivery_date": f"{day} {10 + hours}:00:00",
        } | more

    return tables(
        spark,
        raw_orders=[
            order(1, "Pune", "2025-08-30", 3, status="Failed", failure_reason="address"),
            order(2, "Pune", "2025-08-31", 0, status="Delivered"),
            order(3, "Pune", "2025-07-15", 5, status="failed"),
            order(4, "Chennai", "2025-07-31", 3),
            order(5, "Chennai", "2025-07-01", 0, failure_reason="stock"),
            order(6, "Chennai", "2025-06-30", 0, failure_reason="stock"),
        ],
        raw_warehouse_logs=[{"order_id": i, "warehouse_id": 10 if i < 4 else 2} for i in range(1, 7)],
        dim_warehouses=[{"warehouse_id": i, "warehouse_name": f"Warehouse {i}"} for i in (2, 20, 10)],
        dim_clients=[{"client_id": 0, "client_name": "Even LLC"}, {"client_id": 1, "client_name": "Odd Ltd"}],
    )


@pytest.fixture(scope="module")
def fact(small):
    columns = [*measures.SAMPLE_COLUMNS, "is_late", "order_date", "order_month", "causes"]
    return fact_with_causes(small, *columns).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kpis(fact):
    assert rows(measures.kpis(fact, scopes.equals("city", "Pune"))) == [(3, pytest.approx(200 / 3), pytest.approx(200 / 3))]
    assert rows(measures.kpis(fact, scopes.equals("city", "Nowhere"))) == [(0, 0.0, 0.0)]


def test_top_causes_break_ties_by_name(fact):
    assert rows(measures.top_causes(fact)) == [("late_delivery", 3), ("stockout", 2), ("address_issue", 1), ("unknown", 1)]
    assert rows(measures.top_causes(fact, k=1)) == [("late_delivery", 3)]
    assert rows(measures.top_causes(fact, scopes.equals("city", "Nowhere"))) == []


def test_joined_counts_equal_the_join(spark, fact):
    causes = explode_causes(fact.unionByName(fact))
    doubled = fact.unionByName(fact)
    plain = causes.join(doubled, "order_id").groupBy("city", "cause").count()
    assert sorted(rows(measures.joined_cause_counts(causes, doubled, by=["city"]))) == sorted(rows(plain))


def test_samples(fact):
    got = rows(measures.samples(fact, k=3))
    assert [r[0] for r in got] == [3, 1, 4]
    assert got[0] == (3, "Pune", "Odd Ltd", "Warehouse 10", 5.0, "failed")


def test_recommendations(fact):
    got = rows(measures.recommendations(measures.top_causes(fact), 4))
    assert got[0] == ("late_delivery", "late_delivery: Tighten promise windows and escalate at-risk orders early.")
    assert got[3] == ("unknown", "unknown: Investigate with additional context.")


def test_day_range_takes_the_whole_last_day_and_the_cli_only_its_midnight(fact):
    model = scopes.days_between("2025-08-30", "2025-08-31")
    cli = scopes.orders_matching(start="2025-08-30", end="2025-08-31")
    assert sorted(r.order_id for r in fact.where(model).collect()) == [1, 2]
    assert [r.order_id for r in fact.where(cli).collect()] == [1]


def test_cli_filters(small):
    cli = build_fact(small, "cli")
    assert cli.where(scopes.orders_matching(city="PUNE")).count() == 3
    assert cli.where(scopes.orders_matching(client="llc|none")).count() == 3
    assert cli.where(scopes.orders_matching(warehouse="warehouse 2")).count() == 3
    assert cli.where(scopes.orders_matching()).count() == 6


def test_month_reaches_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "orders")
    small["raw_orders"].write.parquet(path)
    plan = spark.read.parquet(path).where(scopes.in_month("2025-07"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date,2025-07-01T00:00), Less" in plan


def test_month_bounds_at_year_end():
    assert scopes.month_bounds("2025-12") == (dt.datetime(2025, 12, 1), dt.datetime(2026, 1, 1))


def test_explorer_filters(fact):
    kept = fact.where(scopes.explorer("2025-07-01", "2025-08-31", city="Chennai", warehouse="Warehouse 2"))
    assert sorted(r.order_id for r in kept.collect()) == [4, 5]
    answer = explore(fact, "2025-07-01", "2025-08-31", client="Even LLC")
    assert rows(answer["kpis"])[0][0] == 2
    assert [r[0] for r in rows(answer["samples"])] == [4, 2]


def test_calendar_windows(spark, fact):
    last = last_day_seen(fact)
    got = spark.range(1).select(*previous_month(last), *past_week(last)).first()
    assert tuple(got) == (dt.date(2025, 7, 1), dt.date(2025, 7, 31), dt.date(2025, 8, 24), dt.date(2025, 8, 31))


def test_missing_days_are_today_and_order_is_restored(spark):
    today = spark.sql("select current_date()").first()[0]
    early, late = dt.date(2020, 1, 1), dt.date(2021, 1, 1)
    got = spark.range(1).select(*ordered_days(F.lit(late), F.lit(early)), *ordered_days(F.lit(early), F.lit(None))).first()
    assert tuple(got) == (early, late, early, today)


def test_range_complete():
    full = dict.fromkeys(["order_min_date", "order_max_date", "dataset_min_date", "dataset_max_date"], "2025-01-01")
    assert scopes.range_complete(full)
    assert not scopes.range_complete(full | {"dataset_max_date": None})


def test_date_ranges(small):
    got = measures.date_ranges(small).first()
    assert (got.order_min_date, got.order_max_date) == (dt.date(2025, 6, 30), dt.date(2025, 8, 31))
    assert (got.dataset_min_date, got.dataset_max_date) == (dt.date(2025, 6, 30), dt.date(2025, 8, 31))


def test_filter_options(fact):
    assert rows(measures.distinct_values(fact, "client_name")) == [("Even LLC",), ("Odd Ltd",)]


def test_city_report(fact):
    assert rows(measures.city_report(fact)) == [("Pune", 3, 66.67), ("Chennai", 3, 33.33)]


def test_model_stats(fact):
    assert dict(rows(measures.model_stats(fact))) == {
        "fact_order_analysis_rows": 6, "fact_order_causes_rows": 7, "unique_causes": 4,
    }


# ---- templates -----------------------------------------------------------------


def test_city_template(fact):
    answer = run_template(fact, "city_delayed_date_range", city="Pune", start="2025-07-01", end="2025-08-30")
    assert rows(answer["kpis"])[0][0] == 2
    assert answer["header"].first().scope == "City=Pune, Date Range=2025-07-01 to 2025-08-30"


def test_client_template_counts_causes_of_failed_orders_only(fact):
    answer = run_template(fact, "client_failures_past_week", client="Odd Ltd")
    assert rows(answer["kpis"]) == [(1, 100.0, 100.0)]
    assert rows(answer["causes"]) == [("address_issue", 1), ("late_delivery", 1)]
    answer = run_template(fact, "client_failures_past_week", client="Even LLC")
    assert rows(answer["kpis"])[0][0] == 1 and rows(answer["causes"]) == []
    assert answer["header"].first().scope == "Client=Even LLC, Period=2025-08-24 to 2025-08-31, Failed orders only"


def test_warehouse_template(fact):
    answer = run_template(fact, "warehouse_august_reasons", warehouse="Warehouse 10")
    assert answer["header"].first().scope == "Warehouse=Warehouse 10, Month=2025-08"
    assert rows(answer["kpis"])[0][0] == 2
    assert rows(run_template(fact, "warehouse_august_reasons", warehouse="Warehouse 1")["kpis"]) == [(0, 0.0, 0.0)]


def test_compare_template(fact):
    answer = run_template(fact, "city_vs_city_last_month", city="Pune", city_b="Chennai")
    assert rows(answer["kpis"]) == [(1, 2)]
    assert rows(answer["compare"]) == [("Chennai", "late_delivery", 1), ("Chennai", "stockout", 1), ("Pune", "late_delivery", 1)]
    assert answer["recommendations"].count() == 2


def test_festival_and_onboarding_templates(fact):
    empty = run_template(fact, "festival_period_risks")
    assert empty["header"].first().scope == "Festival window assumed as October 2025"
    assert rows(empty["kpis"]) == [(0, 0.0, 0.0)] and rows(empty["recommendations"]) == []
    network = run_template(fact, "client_onboarding_risk")
    assert network["header"].first().scope == "Network baseline + projected 20,000 additional monthly orders"
    assert network["kpis"].first().projected_delayed_orders == 10000


def test_unknown_template(fact):
    answer = run_template(fact, "weather forecast")
    assert tuple(answer["header"].first()) == ("Analysis", "", "")
    assert set(answer) == {"header", "kpis", "causes", "samples", "recommendations"}
    assert all(answer[part].count() == 0 for part in ("kpis", "causes", "samples", "recommendations"))


def test_templates_from_tables_make_only_the_joins_they_need(small):
    answer = run_template(
        lambda *columns: fact_with_causes(small, *columns),
        "city_delayed_date_range", city="Pune", start="2025-07-01", end="2025-08-30",
    )
    assert rows(answer["kpis"])[0][0] == 2
    plan = answer["kpis"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize(
    "question,template",
    [
        ("Compare failures of city A vs city B", "city_vs_city_last_month"),
        ("Compare delay causes between Pune and Chennai last month", "city_delayed_date_range"),
        ("Explain the top reasons linked to Warehouse B", "warehouse_august_reasons"),
        ("Why did Client X's orders FAIL?", "client_failures_past_week"),
        ("the holiday of a client", "festival_period_risks"),
        ("onboard someone", "client_onboarding_risk"),
        ("Why were deliveries delayed in city X yesterday?", "city_delayed_date_range"),
        ("hello", "city_delayed_date_range"),
    ],
)
def test_routing(spark, question, template):
    row = route_questions(spark.createDataFrame([(question,)], "question string")).first()
    assert row.template_id == template
    assert row.reason.startswith("Mapped") is (question.startswith("Compare delay") or question == "hello")


# ---- insights -------------------------------------------------------------------


def test_insight_repeats_an_order_once_per_cause(fact):
    row = insights(fact, {"Pune": scopes.equals("city", "Pune")}).first()
    assert (row.orders_considered, row.late_rate) == (3, 66.67)
    assert [tuple(c) for c in row.top_causes] == [("late_delivery", 2), ("address_issue", 1), ("unknown", 1)]
    assert row.sample_orders == [3, 1, 1, 2]
    distinct = insights(fact, {"Pune": scopes.equals("city", "Pune")}, distinct_orders=True).first()
    assert distinct.sample_orders == [3, 1, 2]


def test_actions_only_for_causes_that_have_one(spark):
    t = tables(spark, raw_orders=[{"order_id": 1}], raw_feedback=[{"order_id": 1, "feedback_text": "cancel, late"}])
    cli = fact_with_causes(t, "order_id", "delay_hours", "is_late", "causes", preset="cli")
    row = insights(cli, {"all": F.lit(True)}).first()
    assert [c.cause for c in row.top_causes] == ["cancellation", "late_delivery"]
    assert row.recommendations == ["late_delivery: Improve ETA promises; increase visibility with live tracking."]


def test_empty_scope(fact):
    row = insights(fact, {"none": scopes.equals("city", "Nowhere")}).first()
    assert (row.orders_considered, row.late_rate, row.top_causes, row.recommendations, row.sample_orders) == (0, 0.0, [], [], [])
    assert row.narrative == "No orders matched the filter."


def test_narrative(fact):
    lines = insights(fact, {"Chennai": scopes.equals("city", "Chennai")}).first().narrative.split("\n")
    assert lines[:5] == ["Scope: Chennai", "Orders analyzed: 3", "Late/failed rate: 33.33%", "Top causes:", "- stockout: 2"]
    assert lines[-1] == "Sample impacted order_ids: [4, 5, 6]"


def test_every_value_of_a_dimension_at_once(fact):
    got = {r.city: r.orders_considered for r in insights_by(fact, ["city"]).collect()}
    assert got == {"Pune": 3, "Chennai": 3}


def test_projection(spark, fact):
    assert spark.range(1).select(projected_late(20000, F.lit(12.71))).first()[0] == 2542
    row = onboarding(fact, "Client Y").first()
    assert row.projected_delayed_orders == 10000
    assert "Baseline late rate: 50.0% | projected delayed orders per month: ~10000" in row.narrative
    assert row.narrative.endswith("contactability checks on day 1.")


def test_constant_texts_of_the_templates(spark):
    """Titles, scopes and fixed advice come from no table, so they are tested here and not registered."""
    from shipcause.fixed import COMPARE_RECOMMENDATIONS, TITLES

    fact = infer_causes(build_fact(tables(spark, raw_orders=[{"order_id": 1, "order_date": "2025-08-10 00:00:00"}]), "model"))
    scope = lambda template, **a: run_template(fact, template, **a)["header"].first()
    assert scope("city_delayed_date_range", city="Pune", start="2025-08-01", end="2025-08-31").scope == "City=Pune, Date Range=2025-08-01 to 2025-08-31"
    assert scope("warehouse_august_reasons", warehouse="W", month="2025-08").scope == "Warehouse=W, Month=2025-08"
    assert scope("festival_period_risks", month="2025-10").scope == "Festival window assumed as October 2025"
    assert scope("client_onboarding_risk").title == TITLES["client_onboarding_risk"]
    compare = run_template(fact, "city_vs_city_last_month", city="A", city_b="B")
    assert [r.recommendation for r in compare["recommendations"].collect()] == COMPARE_RECOMMENDATIONS
