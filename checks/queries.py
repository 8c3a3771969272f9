"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame.

All of them start from the eight input tables that ``shipcause.testdata`` derives, and read them whole.
Lists are returned as text, days as ``yyyy-MM-dd`` and rates rounded to six digits, so that the results can
be compared value by value with those of another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shipcause import testdata
from shipcause.fixed import DATE_COLUMNS, TABLE_FILES
from shipcause.functions.dates import (
    day_text,
    normalize_dates,
    ordered_days,
    second_text,
    strict_timestamp,
)
from shipcause.functions.values import labels_where, normalize_missing
from shipcause.operators import measures, quality, scopes
from shipcause.operators.causes import distinct_recommendations, explode_causes, infer_causes
from shipcause.operators.fact import (
    build_fact,
    dispatch_lag_minutes,
    fact_with_causes,
    picking_minutes,
    transit_hours,
)
from shipcause.operators.fanout import (
    log_grain,
    log_grain_by_warehouse,
    log_grain_causes,
    log_grain_kpis,
    log_grain_top_causes,
)
from shipcause.operators.feedback import feedback_summary_cli, feedback_summary_model, feedback_text, feedback_text_rows
from shipcause.operators.firsts import first_row_per_key, first_value_per_key, worst_factor
from shipcause.operators.insights import insights_by, insights_grouping_sets, onboarding
from shipcause.plans import scenarios, templates
from shipcause.plans.model import Model, open_model, refresh, save_model
from shipcause.plans.questions import route_questions
from shipcause.schemas import FACT_COLUMNS, SEQ, TABLE_KEYS
from shipcause.sources.presence import source_report
from shipcause.sources.query import run_query, run_select
from shipcause.sources.store import new_folder, write_csv, write_table
from shipcause.sources.tables import load_csv, load_csv_folder, load_csv_tables, normalize, read_csv, row_counts


Query = Callable[[SparkSession, str], DataFrame]

CITY, CITY_A, CITY_B = "NATION_7", "NATION_11", "NATION_1"
START, END = "1995-01-01", "2001-08-01"
WAREHOUSE, WAREHOUSE_MONTH = "Warehouse 3", "1996-08"
FESTIVAL_MONTH, EMPTY_MONTH = "1996-10", "2001-10"
CLIENT_PATTERN, WAREHOUSE_PATTERN = "customer#00000010", "warehouse 2"
CLI_START, CLI_END = "1996-08-01", "1996-08-31"


# ---- helpers -------------------------------------------------------------------


@lru_cache(maxsize=8)
def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The input tables as plans (no data is kept)."""
    return testdata.load_tables(spark, folder)


def model(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return fact_with_causes(load_tables(spark, folder), *columns)


def model_reader(spark: SparkSession, folder: str) -> Callable[..., DataFrame]:
    return partial(fact_with_causes, load_tables(spark, folder))


def cli(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["order_id", "city", "client_name", "warehouse_name", "order_date", "delay_hours", "is_late", "causes"]
    return fact_with_causes(load_tables(spark, folder), *columns, preset="cli")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def counts_as_text(df: DataFrame) -> DataFrame:
    """Wide decimal counts as text, which holds them at any size."""
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t.startswith("decimal")})


def kpi_row(df: DataFrame) -> DataFrame:
    return rounded(df, "late_rate", "failed_rate")


def list_text(c: str | Column) -> Column:
    return F.array_join(c, "; ")


def insight_text(df: DataFrame) -> DataFrame:
    """Lists of an insight as text, column names kept."""
    return df.withColumns(
        {
            "top_causes": list_text(F.transform("top_causes", lambda x: F.concat(x["cause"], F.lit("="), x["n"]))),
            "recommendations": list_text("recommendations"),
            "sample_orders": list_text(F.transform("sample_orders", lambda x: x.cast("string"))),
        }
    )


# ---- sources and sinks -----------------------------------------------------------


def load_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The tables written as CSV files and loaded back from them."""
    return row_counts(load_csv_tables(spark, csv_folder(load_tables(spark, folder), new_folder(spark, "csv"))))


#: Rows of a part of a written CSV, which one task reads: some 50 MB of text.
PART_ROWS = 500_000


def csv_folder(tables: dict[str, DataFrame], out: str) -> str:
    """Tables written to ``out`` under their usual file names, logs in the order of their rows; gzipped, as text would fill
    the disk."""
    for table, df in tables.items():
        df = df.orderBy(SEQ).drop(SEQ) if SEQ in df.columns else df
        write_csv(df, f"{out}/{TABLE_FILES[table]}", "gzip", PART_ROWS)
    return out


def write_lines(lines: DataFrame, header: str, out: str, parts: int = 8) -> str:
    """A CSV of ``parts`` files written as text: ``lines`` has number and line, in which anything may stand."""
    spark = lines.sparkSession
    heads = spark.range(parts).select(F.col("id").alias("part"), F.lit(None).cast("bigint").alias("number"), F.lit(header).alias("line"))
    rows = heads.unionByName(lines.select(F.pmod(F.xxhash64("number"), F.lit(parts)).alias("part"), "number", "line"))
    rows = rows.repartition("part").sortWithinPartitions("part", "number")  # headers first
    rows.select("part", "line").write.partitionBy("part").text(out)
    return f"{out}/part=*"


#: Texts of feedback with all that makes CSV hard; the same in both dialects.
HARD_TEXT = """case load_seq % 5 when 0 then feedback_text || chr(10) || chr(10) || 'second line, "quoted"' || chr(10)
    when 1 then '5" box: ' || feedback_text when 2 then '"' || feedback_text || '","' else feedback_text end"""


def csv_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback as CSV with line breaks and quotes in cells, some quotes inside cells that are not quoted."""
    feedback = load_tables(spark, folder)["raw_feedback"].withColumn("feedback_text", F.expr(HARD_TEXT))
    quoted = F.concat(F.lit('"'), F.replace("feedback_text", F.lit('"'), F.lit('""')), F.lit('"'))
    cell = F.when(F.col(SEQ) % 5 == 1, F.col("feedback_text")).otherwise(quoted)
    line = F.concat_ws(",", F.col(SEQ).cast("string"), F.coalesce(cell, F.lit("")), F.col("order_id").cast("string"))
    path = write_lines(feedback.select(F.col(SEQ).alias("number"), line.alias("line")), "event_id,feedback_text,order_id", new_folder(spark, "csv"))
    rows = read_csv(spark, path)
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), "feedback_text", F.col("order_id").cast("bigint").alias("order_id"))


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as CSV, some records with a cell too many or too few: which were loaded, and why the others were not."""
    orders = load_tables(spark, folder)["raw_orders"]
    cells = [F.col("order_id").cast("string"), F.col("city"), F.col("status")]
    line = (
        F.when(F.col("order_id") % 50 == 3, F.concat_ws(",", *cells, F.lit('"x, y"'), F.lit("")))
        .when(F.col("order_id") % 50 == 4, F.concat_ws(",", *cells[:2]))
        .otherwise(F.concat_ws(",", *cells))
    )
    path = write_lines(orders.select(F.col("order_id").alias("number"), line.alias("line")), "order_id,city,status", new_folder(spark, "csv"))
    found = load_csv(spark, path, short_rows="reject")
    loaded = found.rows.select("order_id", F.lit("loaded").alias("reason"), F.lit(3).alias("cells"))
    rejected = found.rejects.select(F.split("record", ",")[0].alias("order_id"), "reason", "cells")
    return loaded.unionByName(rejected).withColumn("order_id", F.col("order_id").cast("bigint"))


def csv_text_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and feedback as CSV, some order ids texts: these stay as they are in both tables, and join."""
    tables = {t: load_tables(spark, folder)[t] for t in ("raw_orders", "raw_feedback")}
    number = F.col("order_id").cast("string")
    some_texts = F.when(F.col("order_id") % 100 == 7, F.concat(F.lit("ORD-"), number)).when(F.col("order_id") % 100 == 8, F.concat(F.lit("00"), number))
    out = csv_folder({t: df.withColumn("order_id", F.coalesce(some_texts, number)) for t, df in tables.items()}, new_folder(spark, "csv"))
    loaded = load_csv_folder(spark, out, files={t: TABLE_FILES[t] for t in tables}).tables
    feedback = loaded["raw_feedback"].groupBy("order_id").agg(F.count(F.lit(1)).alias("n_feedback"))
    orders = loaded["raw_orders"].select("order_id", "client_id", F.typeof("order_id").alias("order_id_type"), F.typeof("client_id").alias("client_id_type"))
    return orders.join(feedback, "order_id", "left")


def csv_first_values(spark: SparkSession, folder: str) -> DataFrame:
    """The first values of a log that was loaded from CSV, where the order of rows is their position."""
    logs = {t: df for t, df in load_tables(spark, folder).items() if t == "raw_warehouse_logs"}
    out = csv_folder(logs, new_folder(spark, "csv"))
    loaded = load_csv_folder(spark, out, files={t: TABLE_FILES[t] for t in logs}).tables["raw_warehouse_logs"]
    return first_value_per_key(loaded, "order_id", SEQ, ["warehouse_id", "picking_end", "notes"])


def csv_dated_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All tables as CSV with days as one number and instants in a regional form: every date that comes back."""
    tables, forms = load_tables(spark, folder), ("yyyyMMddHHmmss", "MM/dd/yyyy HH:mm:ss")
    written = {
        t: df.withColumns({c: F.date_format(c, forms[i % 2]) for i, c in enumerate(DATE_COLUMNS[t])}) for t, df in tables.items()
    }
    loaded = load_csv_tables(spark, csv_folder(written, new_folder(spark, "csv")), formats=forms[1:])
    parts = [
        loaded[t].select(F.col(TABLE_KEYS[t]).alias("key"), *[second_text(c).alias(c) for c in DATE_COLUMNS[t]])
        .unpivot("key", DATE_COLUMNS[t], "column_name", "value").withColumn("table_name", F.lit(t))
        for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def refresh_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All tables written as CSV, a model refreshed from them twice, and its fact as readers open it."""
    data, out = csv_folder(load_tables(spark, folder), new_folder(spark, "csv")), new_folder(spark, "model")
    refresh(spark, data, out, keep=1)
    refresh(spark, data, out, keep=1)
    return open_model(spark, out).fact.select(*FACT_COLUMNS)


def source_presence(spark: SparkSession, folder: str) -> DataFrame:
    """The expected files, one of which has not been written."""
    tables = {t: df for t, df in load_tables(spark, folder).items() if t != "dim_clients"}
    return source_report(spark, csv_folder(tables, new_folder(spark, "csv")))


def dq_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Declared against loaded types after a CSV load in which some amounts are no numbers."""
    tables = load_tables(spark, folder)
    amount = F.when(F.col("order_id") % 20 == 3, "unknown sum").when(F.col("order_id") % 20 == 4, "NA").otherwise(F.col("amount").cast("string"))
    tables |= {"raw_orders": tables["raw_orders"].withColumn("amount", amount)}
    return quality.schema_log(load_csv_tables(spark, csv_folder(tables, new_folder(spark, "csv"))))


def date_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Per order: its dates as strict timestamps, two days in order with today for a missing one, complete or not."""
    orders = load_tables(spark, folder)["raw_orders"]
    promised = strict_timestamp(F.col("promised_delivery_date").cast("string"))
    first, last = ordered_days(promised, F.col("actual_delivery_date"))
    complete = scopes.all_present("order_date", "promised_delivery_date", "actual_delivery_date")
    is_today = (last == F.current_date()) & F.col("actual_delivery_date").isNull()
    return orders.select(
        "order_id", day_text(first).alias("first_day"), F.when(is_today, "today").otherwise(day_text(last)).alias("last_day"),
        complete.alias("complete"),
    )


def na_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Texts for "no value" planted in the event types; look-alikes stay."""
    factors = load_tables(spark, folder)["raw_external_factors"]
    planted = (
        F.when(F.col(SEQ) % 9 == 0, "None").when(F.col(SEQ) % 9 == 1, "N/A").when(F.col(SEQ) % 9 == 2, "none")
        .when(F.col(SEQ) % 9 == 3, " NA").when(F.col(SEQ) % 9 == 4, "<NA>").otherwise(F.col("event_type"))
    )
    rows = factors.select(F.col(SEQ).alias("event_id"), "order_id", planted.alias("event_type"))
    return normalize_missing(rows)


def _order_date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as texts of mixed forms, some of them no dates."""
    orders = load_tables(spark, folder)["raw_orders"]
    text = second_text("order_date")
    return orders.select(
        "order_id",
        F.when(F.col("order_id") % 7 == 0, "not a date")
        .when(F.col("order_id") % 7 == 1, F.concat(text, F.lit(".987654")))
        .when(F.col("order_id") % 7 == 2, F.substring(text, 1, 10))
        .when(F.col("order_id") % 7 == 3, F.concat(F.substring(text, 1, 10), F.lit("T23:59:59")))
        .otherwise(text)
        .alias("order_date"),
        F.when(F.col("order_id") % 5 == 0, "32/13/2020")
        .when(F.col("order_id") % 5 == 1, F.lit(None))
        .when(F.col("order_id") % 5 == 2, "NA")
        .otherwise(text)
        .alias("created_at"),
    )


def normalize_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    parsed = normalize_dates(normalize_missing(_order_date_texts(spark, folder)), ["order_date", "created_at"])
    return parsed.select("order_id", "order_date", second_text("created_at").alias("created_text"))


def epoch_ns_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """One column holds epoch nanoseconds only, the other holds them beside dates."""
    events = load_tables(spark, folder)["raw_feedback"]
    day = second_text("created_at")
    nanos = (F.lit(1_700_000_000_123_456_789) + F.col(SEQ) * 1_000_000_007).cast("string")
    rows = events.select(
        F.col(SEQ).alias("event_id"),
        nanos.alias("created_at"),
        F.when(F.col(SEQ) % 100 == 0, day).otherwise(nanos).alias("recorded_at"),
    )
    return normalize_dates(rows, ["created_at", "recorded_at", "absent"])


def sink_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The cause table written as Parquet and read back."""
    fact = model(spark, folder, "order_id", "causes")
    return write_table(explode_causes(fact), f"{new_folder(spark, 'causes')}/fact_order_causes")


def saved_model_months(spark: SparkSession, folder: str) -> DataFrame:
    """The model saved by month; KPIs of one year read from its partitions."""
    saved = save_model(load_tables(spark, folder), new_folder(spark, "model")).fact
    year = saved.where(scopes.days_between("1996-01-01", "1996-12-31", month="order_month"))
    return kpi_row(measures.kpis(year, by=["order_month"]))


def sql_params(spark: SparkSession, folder: str) -> DataFrame:
    model(spark, folder, "order_id", "city", "order_date", "delay_hours").createOrReplaceTempView("fact_order_analysis")
    sql = """
        select city, count(*) as total_orders, round(sum(delay_hours), 6) as delay_hours
        from fact_order_analysis where to_date(order_date) between cast(? as date) and cast(? as date) and city <> ?
        group by city"""
    return run_query(spark, sql, [START, END, CITY])


def adhoc_city_report(spark: SparkSession, folder: str) -> DataFrame:
    model(spark, folder, "city", "is_late").createOrReplaceTempView("fact_order_analysis")
    return run_select(
        spark,
        """
        SELECT city, count(*) AS total_orders, round(avg(is_late) * 100, 2) AS late_rate_pct
        FROM fact_order_analysis GROUP BY city ORDER BY late_rate_pct DESC, city LIMIT 10;""",
    ).rows


def model_views(spark: SparkSession, folder: str) -> DataFrame:
    """The registered views joined in SQL."""
    tables = load_tables(spark, folder)
    fact = fact_with_causes(tables, "order_id", "city", "causes")
    Model(tables, fact, explode_causes(fact)).register()
    return spark.sql("""
        select s.cause, s.cause_count, count(distinct c.order_id) as n_orders, sum(e.traffic_score) as traffic_scores,
            round(sum(f.feedback_rating_avg), 6) as ratings, sum(length(f.feedback_text_concat)) as chars
        from v_cause_summary s join fact_order_causes c on c.cause = s.cause
            left join v_external_best e on e.order_id = c.order_id
            left join v_feedback_summary f on f.order_id = c.order_id
        group by s.cause, s.cause_count""")


# ---- one row per order -------------------------------------------------------------


def log_durations(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_tables(spark, folder)
    stock = tables["raw_warehouse_logs"].groupBy("order_id").agg(
        F.round(F.sum(picking_minutes()), 6).alias("picking_minutes"),
        F.round(F.sum(dispatch_lag_minutes()), 6).alias("dispatch_lag_minutes"),
    )
    fleet = tables["raw_fleet_logs"].groupBy("order_id").agg(F.round(F.sum(transit_hours()), 6).alias("transit_hours"))
    return stock.join(fleet, "order_id", "full")


def first_row_log(spark: SparkSession, folder: str) -> DataFrame:
    logs = load_tables(spark, folder)["raw_warehouse_logs"]
    return first_row_per_key(logs, "order_id", [SEQ], ["warehouse_id", "picking_end", "notes"])


def first_non_null_log(spark: SparkSession, folder: str) -> DataFrame:
    logs = load_tables(spark, folder)["raw_warehouse_logs"]
    return first_value_per_key(logs, "order_id", SEQ, ["warehouse_id", "picking_end", "notes"])


def factor(preset: str) -> Query:
    return lambda spark, folder: worst_factor(load_tables(spark, folder)["raw_external_factors"], preset)


def q_feedback_summary_model(spark: SparkSession, folder: str) -> DataFrame:
    feedback = load_tables(spark, folder)["raw_feedback"]
    return rounded(
        feedback_summary_model(feedback).join(feedback_text(feedback), "order_id", "left"), "feedback_rating_avg"
    )


def q_feedback_summary_cli(spark: SparkSession, folder: str) -> DataFrame:
    summary = feedback_summary_cli(load_tables(spark, folder)["raw_feedback"])
    return rounded(summary.withColumn("feedback_tags", list_text("feedback_tags")), "feedback_rating_avg")


# ---- facts and causes -----------------------------------------------------------------


def fact_order(spark: SparkSession, folder: str) -> DataFrame:
    return build_fact(load_tables(spark, folder), "model", FACT_COLUMNS)


def fact_order_cli(spark: SparkSession, folder: str) -> DataFrame:
    fact = build_fact(load_tables(spark, folder), "cli")
    return fact.withColumns({"feedback_tags": list_text("feedback_tags"), "is_late": F.col("is_late").cast("int")})


def fact_order_log_grain(spark: SparkSession, folder: str) -> DataFrame:
    return counts_as_text(rounded(log_grain(load_tables(spark, folder)), "feedback_rating_avg"))


def q_log_grain_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return counts_as_text(kpi_row(log_grain_kpis(log_grain(load_tables(spark, folder)), by=["city"])))


def q_log_grain_causes(spark: SparkSession, folder: str) -> DataFrame:
    return counts_as_text(log_grain_causes(log_grain(load_tables(spark, folder)), joined=False))


def q_log_grain_top_causes(spark: SparkSession, folder: str) -> DataFrame:
    return counts_as_text(log_grain_top_causes(log_grain(load_tables(spark, folder))))


def log_grain_warehouse_kpis(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_tables(spark, folder)
    return counts_as_text(kpi_row(log_grain_by_warehouse(tables, log_grain(tables))))


def causes_model(spark: SparkSession, folder: str) -> DataFrame:
    return explode_causes(model(spark, folder, "order_id", "causes"))


def causes_cli(spark: SparkSession, folder: str) -> DataFrame:
    fact = fact_with_causes(load_tables(spark, folder), "order_id", "causes", preset="cli")
    return explode_causes(fact, keep_empty=True)


def cause_summary(spark: SparkSession, folder: str) -> DataFrame:
    return measures.cause_counts(model(spark, folder, "causes"))


def q_model_stats(spark: SparkSession, folder: str) -> DataFrame:
    return measures.model_stats(model(spark, folder, "order_id", "causes"))


def recommendations_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_recommendations(causes_model(spark, folder))


# ---- scopes and measures ---------------------------------------------------------------


def city_scope() -> Column:
    return scopes.all_of(scopes.equals("city", CITY), scopes.days_between(START, END))


def kpi_scope(spark: SparkSession, folder: str) -> DataFrame:
    return kpi_row(measures.kpis(model(spark, folder, "status", "is_late", "city", "order_date"), city_scope()))


def top_causes(spark: SparkSession, folder: str) -> DataFrame:
    """The cause table joined back to the fact, as counts."""
    fact = model(spark, folder, "order_id", "city", "order_date")
    return counts_as_text(measures.top(measures.joined_cause_counts(causes_model(spark, folder), fact, city_scope())))


def samples_scope(spark: SparkSession, folder: str) -> DataFrame:
    return measures.samples(model(spark, folder, *measures.SAMPLE_COLUMNS, "order_date"), city_scope())


def filter_orders_cli(spark: SparkSession, folder: str) -> DataFrame:
    """Four filters at once, each order listed under every one that keeps it."""
    fact = build_fact(
        load_tables(spark, folder), "cli", ["order_id", "city", "client_name", "warehouse_name", "order_date"]
    )
    kept = {
        "city": scopes.orders_matching(city="nation_7"),
        "client": scopes.orders_matching(client=CLIENT_PATTERN),
        "warehouse and month": scopes.orders_matching(warehouse=WAREHOUSE_PATTERN, start=CLI_START, end=CLI_END),
        "city and start": scopes.orders_matching(city="NATION_11", start="2000-01-01"),
    }
    return fact.select(
        "order_id", "city", "client_name", "warehouse_name",
        F.explode(labels_where(kept)).alias("kept_by"),
    )


def dynamic_filter(spark: SparkSession, folder: str) -> DataFrame:
    fact = model(spark, folder, "order_id", "city", "client_name", "warehouse_name", "order_date")
    return fact.where(scopes.explorer(START, END, city=scopes.ALL, warehouse=WAREHOUSE)).withColumn(
        "order_date", second_text("order_date")
    )


def filter_options(name: str) -> Query:
    return lambda spark, folder: measures.distinct_values(model(spark, folder, name), name)


def q_date_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = measures.date_ranges(load_tables(spark, folder))
    return ranges.select(*[day_text(F.col(c)).alias(c) for c in ranges.columns])


def explorer_part(part: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        answer = templates.explore(model_reader(spark, folder), START, END, city=CITY_A, warehouse=WAREHOUSE)[part]
        return kpi_row(answer) if part == "kpis" else answer

    return query


# ---- question templates ------------------------------------------------------------------


def failing_client(fact: templates.Fact) -> Column:
    """The first client, by name, with a failed order in the past week."""
    rows = fact("client_name", "status", "order_date")
    inside = scopes.days_between(*templates.last_week(fact)) & scopes.failed()
    return rows.where(inside).agg(F.min("client_name")).scalar()


def answer(template: str, fact: templates.Fact) -> templates.Answer:
    if template == "t1":
        return templates.run_template(fact, "city_delayed_date_range", city=CITY, start=START, end=END)
    if template == "t2":
        return templates.run_template(fact, "client_failures_past_week", client=failing_client(fact))
    if template == "t3":
        return templates.run_template(fact, "warehouse_august_reasons", warehouse=WAREHOUSE, month=WAREHOUSE_MONTH)
    if template == "t4":
        return templates.run_template(fact, "city_vs_city_last_month", city=CITY_A, city_b=CITY_B)
    if template == "t5":
        return templates.run_template(fact, "festival_period_risks", month=FESTIVAL_MONTH)
    return templates.run_template(fact, "client_onboarding_risk")


def template_part(template: str, part: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        frame = answer(template, model_reader(spark, folder))[part]
        return kpi_row(frame) if part == "kpis" and template != "t4" else frame

    return query


def empty_month_kpis(spark: SparkSession, folder: str) -> DataFrame:
    reader = model_reader(spark, folder)
    return templates.run_template(reader, "festival_period_risks", month=EMPTY_MONTH)["kpis"]


# ---- insights -----------------------------------------------------------------------------


def insight_city(spark: SparkSession, folder: str) -> DataFrame:
    return insight_text(scenarios.city_scenario(cli(spark, folder), "City", "nation_7")).drop("narrative")


def insight_client(spark: SparkSession, folder: str) -> DataFrame:
    return insight_text(scenarios.client_scenario(cli(spark, folder), "Client", CLIENT_PATTERN)).drop("narrative")


def insight_warehouse(spark: SparkSession, folder: str) -> DataFrame:
    found = scenarios.warehouse_scenario(cli(spark, folder), "Warehouse", WAREHOUSE_PATTERN, CLI_START, CLI_END)
    return insight_text(found).drop("narrative")


def insight_peak(spark: SparkSession, folder: str) -> DataFrame:
    """A period without orders."""
    return insight_text(scenarios.peak_scenario(cli(spark, folder), "Peak", "2001-10-01", "2001-10-31"))


def compare_cities_cli(spark: SparkSession, folder: str) -> DataFrame:
    return insight_text(scenarios.compare_cities(cli(spark, folder), CITY_A, CITY_B, START, END)).drop("narrative")


def narrative(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.city_scenario(cli(spark, folder), "City", CITY).select("scope", "narrative")


def onboarding_cli(spark: SparkSession, folder: str) -> DataFrame:
    return insight_text(onboarding(cli(spark, folder), "Client Y"))


def answer_all(spark: SparkSession, folder: str) -> DataFrame:
    ask = scenarios.Scenarios(
        city=CITY, client=CLIENT_PATTERN, warehouse=WAREHOUSE_PATTERN, month=(CLI_START, CLI_END),
        cities=(CITY_A, CITY_B), peak=("2001-10-01", "2001-10-31"), new_client="Client Y",
    )
    return insight_text(scenarios.answer_all(cli(spark, folder), ask)).drop("narrative")


def insights_of(dimension: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        fact = cli(spark, folder).select(dimension, "order_id", "delay_hours", "is_late", "causes")
        return insight_text(insights_by(fact, [dimension]))

    return query


def q_insights_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return insight_text(insights_grouping_sets(cli(spark, folder)))


def question_routing(spark: SparkSession, folder: str) -> DataFrame:
    """One question per order, made of its city and client."""
    orders = load_tables(spark, folder)["raw_orders"]
    kind = F.col("order_id") % 13
    forms = [
        ("Compare failures of city ", "city", " vs another city"),
        ("Compare delay causes between ", "city", " and Chennai last month"),
        ("  EXPLAIN the reasons for WAREHOUSE problems in ", "city", ""),
        ("warehouse near ", "city", " in general"),
        ("Why did client ", "customer_name", " fail"),
        ("client ", "customer_name", " last WEEK"),
        ("client ", "customer_name", " before the holiday"),
        ("What happens in peak season in ", "city", "?"),
        ("onboard ", "customer_name", " please"),
        ("20,000 more orders of ", "customer_name", ""),
        ("Why were deliveries delayed in city ", "city", " yesterday?"),
        ("city ", "city", " overview"),
    ]
    text = F.concat(F.lit("Anything about "), F.col("city"))
    for i, (before, column, after) in enumerate(forms):
        text = F.when(kind == i, F.concat(F.lit(before), F.col(column), F.lit(after))).otherwise(text)
    return route_questions(orders.select("order_id", text.alias("question")))


# ---- data checks ----------------------------------------------------------------------------


def dq_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of three tables blanked here and there."""
    tables = load_tables(spark, folder)
    orders = tables["raw_orders"].withColumn("order_id", F.when(F.col("order_id") % 10 != 3, F.col("order_id")))
    feedback = tables["raw_feedback"].withColumn("order_id", F.when(F.col(SEQ) % 4 != 1, F.col("order_id")))
    return quality.null_keys(tables | {"raw_orders": orders, "raw_feedback": feedback})


def dq_duplicate_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that occur more than once in the fleet logs (they are unique in the order table)."""
    return quality.duplicate_keys(load_tables(spark, folder)["raw_fleet_logs"], "order_id")


def dq_invalid_dates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.invalid_dates(_order_date_texts(spark, folder), "raw_orders")


def dq_orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    """References checked against an order table in which every fifth order has another id."""
    tables = load_tables(spark, folder)
    renamed = F.when(F.col("order_id") % 5 == 0, -F.col("order_id") - 1).otherwise(F.col("order_id"))
    return quality.orphan_keys(tables | {"raw_orders": tables["raw_orders"].withColumn("order_id", renamed)})


def q_feedback_text_rows(spark: SparkSession, folder: str) -> DataFrame:
    return feedback_text_rows(load_tables(spark, folder)["raw_feedback"])


def causes_from_saved_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Causes inferred again from the fact as it was saved."""
    saved = save_model(load_tables(spark, folder), new_folder(spark, "model")).fact
    return explode_causes(infer_causes(saved.drop("causes")))


def csv_compact_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as CSV with days as one number and instants in a regional form, and loaded back."""
    path = f"{new_folder(spark, 'csv')}/orders.csv"
    orders = load_tables(spark, folder)["raw_orders"]
    day, region = F.date_format("order_date", "yyyyMMdd"), F.date_format("promised_delivery_date", "MM/dd/yyyy HH:mm")
    write_csv(orders.select("order_id", day.alias("order_date"), region.alias("promised_delivery_date")), path)
    return normalize(read_csv(spark, path), "raw_orders", ("MM/dd/yyyy HH:mm",)).drop(SEQ)


QUERIES: dict[str, Query] = {
    "load_row_counts": load_row_counts,
    "na_tokens": na_tokens,
    "normalize_timestamps": normalize_timestamps,
    "epoch_ns_fallback": epoch_ns_fallback,
    "sink_roundtrip": sink_roundtrip,
    "saved_model_months": saved_model_months,
    "sql_params": sql_params,
    "adhoc_city_report": adhoc_city_report,
    "model_views": model_views,
    "model_stats": q_model_stats,
    "log_durations": log_durations,
    "first_row_log": first_row_log,
    "first_non_null_log": first_non_null_log,
    "worst_factor_model": factor("model"),
    "worst_factor_cli": factor("cli"),
    "feedback_summary_model": q_feedback_summary_model,
    "feedback_summary_cli": q_feedback_summary_cli,
    "fact_order": fact_order,
    "fact_order_cli": fact_order_cli,
    "fact_order_log_grain": fact_order_log_grain,
    "log_grain_kpis": q_log_grain_kpis,
    "log_grain_causes": q_log_grain_causes,
    "log_grain_top_causes": q_log_grain_top_causes,
    "log_grain_warehouse_kpis": log_grain_warehouse_kpis,
    "causes_model": causes_model,
    "causes_cli": causes_cli,
    "cause_summary": cause_summary,
    "recommendations_distinct": recommendations_distinct,
    "kpi_scope": kpi_scope,
    "top_causes": top_causes,
    "samples_scope": samples_scope,
    "filter_orders_cli": filter_orders_cli,
    "filter_options_city": filter_options("city"),
    "filter_options_client": filter_options("client_name"),
    "filter_options_warehouse": filter_options("warehouse_name"),
    "date_ranges": q_date_ranges,
    "dynamic_filter": dynamic_filter,
    "dynamic_filter_kpis": explorer_part("kpis"),
    "dynamic_filter_causes": explorer_part("causes"),
    "dynamic_filter_samples": explorer_part("samples"),
    **{
        f"{t}_{key}": template_part(t, part)
        for t in ("t1", "t2", "t3", "t5")
        for key, part in [
            ("kpis", "kpis"), ("causes", "causes"), ("samples", "samples"), ("recs", "recommendations"),
        ]
    },
    "t2_header": template_part("t2", "header"),
    "t4_header": template_part("t4", "header"),
    "t4_kpis": template_part("t4", "kpis"),
    "t4_city_compare": template_part("t4", "compare"),
    "t5_empty_month_kpis": empty_month_kpis,
    "t6_kpis": template_part("t6", "kpis"),
    "t6_causes": template_part("t6", "causes"),
    "t6_recs": template_part("t6", "recommendations"),
    "question_routing": question_routing,
    "insight_city": insight_city,
    "insight_client": insight_client,
    "insight_warehouse": insight_warehouse,
    "insight_peak": insight_peak,
    "compare_cities_cli": compare_cities_cli,
    "narrative": narrative,
    "onboarding_cli": onboarding_cli,
    "answer_all": answer_all,
    "insights_by_city": insights_of("city"),
    "insights_by_client": insights_of("client_name"),
    "insights_by_warehouse": insights_of("warehouse_name"),
    "insights_grouping_sets": q_insights_grouping_sets,
    "dq_null_keys": dq_null_keys,
    "dq_duplicate_orders": dq_duplicate_orders,
    "dq_invalid_dates": dq_invalid_dates,
    "dq_orphan_keys": dq_orphan_keys,
    "feedback_text_rows": q_feedback_text_rows,
    "causes_from_saved_fact": causes_from_saved_fact,
    "csv_compact_dates": csv_compact_dates,
    "csv_line_breaks": csv_line_breaks,
    "csv_rejects": csv_rejects,
    "csv_text_ids": csv_text_ids,
    "csv_first_values": csv_first_values,
    "csv_dated_tables": csv_dated_tables,
    "refresh_roundtrip": refresh_roundtrip,
    "source_presence": source_presence,
    "dq_schema": dq_schema,
    "date_windows": date_windows,
}
