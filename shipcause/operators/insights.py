"""Insights: one row per scope with counts, ranked causes, actions, sample orders and a narrative.

A scope is a label on an order. Orders may carry several labels, so any number of scopes - six scenarios,
every city, every client - is answered by the same two passes over the fact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shipcause.fixed import (
    MODEL_ACTIONS,
    NO_ORDERS_TEXT,
    ONBOARDING_PLAYBOOK,
    ONBOARDING_RISKS_TEXT,
    ONBOARDING_VOLUME,
)
from shipcause.functions.values import labels_where, round_half_even
from shipcause.operators.causes import action_for
from shipcause.sources.store import new_folder, write_table

DIMENSIONS = ["city", "client_name", "warehouse_name"]


def tag_scopes(fact: DataFrame, scopes: Mapping[str, Column]) -> DataFrame:
    """One row per order and scope it belongs to, in a single scan for all scopes."""
    return fact.withColumn("scope", F.explode_outer(labels_where(scopes))).where(F.col("scope").isNotNull())


def _summary(fact: DataFrame, by: Sequence[str], k: int, actions: Mapping[str, str]) -> DataFrame:
    """Per scope the order count, the late rate and the ``k`` most frequent causes with their actions.

    One pass: every order is exploded to its causes and a NULL entry that stands for the order itself.
    Grouped by scope and cause that leaves a few rows per scope, from which the answer is put together.
    """
    entry = F.explode_outer(F.concat("causes", F.array(F.lit(None).cast("string")))).alias("cause")
    counts = (
        fact.select(*by, F.col("is_late").cast("int").alias("late"), entry)
        .groupBy(*by, "cause")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))
    )
    is_order = F.col("cause").isNull()
    ranked = F.collect_list(F.when(~is_order, F.struct((-F.col("n")).alias("minus_n"), "cause")))
    per_scope = counts.groupBy(*by).agg(
        F.max(F.when(is_order, F.col("n"))).alias("orders_considered"),
        F.max(F.when(is_order, F.col("late"))).alias("late"),
        F.slice(F.array_sort(ranked), 1, k).alias("ranked"),
    )

    def advice(item: Column) -> Column:
        return F.concat(item["cause"], F.lit(": "), action_for(item["cause"], actions))

    return per_scope.select(
        *by,
        "orders_considered",
        round_half_even(F.col("late") / F.col("orders_considered") * 100).alias("late_rate"),
        F.transform("ranked", lambda x: F.struct(x["cause"].alias("cause"), (-x["minus_n"]).alias("n"))).alias(
            "top_causes"
        ),
        F.array_compact(F.transform("ranked", advice)).alias("recommendations"),
    )


def _sample_orders(fact: DataFrame, by: Sequence[str], k: int, distinct_orders: bool) -> DataFrame:
    """Per scope the ids of the ``k`` longest delayed entries.

    An order counts once per cause (once when it has none), so its id repeats; ``distinct_orders`` lists
    it once. The window keeps ``k`` rows per scope in each map task, before the shuffle.
    """
    order = [F.desc_nulls_last("delay_hours"), F.col("order_id")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # The k worst orders hold the k worst entries, as every order has one entry at least.
    rows = fact.where(F.col("order_id").isNotNull())
    worst = rows.select(*by, "order_id", "delay_hours", F.size("causes").alias("n")).withColumn("rank", rank)
    times = F.lit(1) if distinct_orders else F.greatest(F.col("n"), F.lit(1))
    entry = F.struct("rank", "order_id", times.alias("times"))
    per_scope = worst.where(F.col("rank") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("worst"))
    repeated = F.flatten(F.transform("worst", lambda x: F.array_repeat(x["order_id"], x["times"])))
    return per_scope.select(*by, F.slice(repeated, 1, k).alias("sample_orders"))


def built_once(fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What the insights read of the fact, written to the shared folder: both passes start from there, so the
    joins and the rules above them run once."""
    narrow = fact.select(*columns, "order_id", "delay_hours", "is_late", "causes")
    return write_table(narrow, new_folder(fact.sparkSession, "insights"))


def insights_by(
    fact: DataFrame,
    by: Sequence[str],
    k: int = 5,
    actions: Mapping[str, str] = MODEL_ACTIONS,
    distinct_orders: bool = False,
    saved: bool = False,
) -> DataFrame:
    """One insight for each value of ``by``: order count, rounded late rate, ranked causes, actions, samples.

    ``saved`` tells that ``fact`` is read from a table, which costs little to read twice.
    """
    by = list(by)
    fact = fact if saved else built_once(fact, by)
    key = F.struct(*by).alias("scope_key")  # NULL is a scope like any other
    summary = _summary(fact, by, k, actions).select(key, "*")
    worst = _sample_orders(fact, by, k, distinct_orders).select(key, "sample_orders")
    return _without_nulls(summary.join(worst, "scope_key", "left").drop("scope_key"))


def _without_nulls(insights: DataFrame) -> DataFrame:
    no_causes = F.array().cast("array<struct<cause:string,n:bigint>>")
    return insights.withColumns(
        {
            "orders_considered": F.coalesce("orders_considered", F.lit(0).cast("bigint")),
            "late_rate": F.coalesce("late_rate", F.lit(0.0)),
            "top_causes": F.coalesce("top_causes", no_causes),
            "recommendations": F.coalesce("recommendations", F.array().cast("array<string>")),
            "sample_orders": F.coalesce("sample_orders", F.array().cast(insights.schema["sample_orders"].dataType)),
        }
    )


def scope_list(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], StructType([StructField("scope", StringType())]))


def insights(
    fact: DataFrame, scopes: Mapping[str, Column], k: int = 5, distinct_orders: bool = False
) -> DataFrame:
    """One insight for each named scope, zeros and empty lists for a scope without orders."""
    found = insights_by(tag_scopes(fact, scopes), ["scope"], k, distinct_orders=distinct_orders)
    asked = scope_list(fact.sparkSession, list(scopes))
    return with_narrative(_without_nulls(asked.join(found, "scope", "left")))


def insights_grouping_sets(
    fact: DataFrame, dimensions: Sequence[str] = DIMENSIONS, k: int = 5, saved: bool = False
) -> DataFrame:
    """Insights for every value of every dimension and for the whole network at once.

    Same rows as ``GROUPING SETS ((city), (client_name), (warehouse_name), ())``.
    """
    fact = fact if saved else built_once(fact, dimensions)
    labels = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    labels.append(F.struct(F.lit("network").alias("dimension"), F.lit(None).cast("string").alias("value")))
    tagged = fact.select("*", F.explode_outer(F.array(*labels)).alias("label")).select(
        "label.*", "order_id", "delay_hours", "is_late", "causes"
    )
    return insights_by(tagged, ["dimension", "value"], k, saved=True)


def rate_text(c: str | Column = "late_rate") -> Column:
    """A rate as Python prints it: no trailing zeros, but at least one digit after the point."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), "0$", ""), r"\.$", ".0")


def with_narrative(insights: DataFrame) -> DataFrame:
    """Add the insight as a text of several lines."""
    cause_lines = F.transform("top_causes", lambda x: F.concat(F.lit("- "), x["cause"], F.lit(": "), x["n"]))
    advice_lines = F.transform("recommendations", lambda x: F.concat(F.lit("- "), x))
    id_list = F.array_join(F.transform("sample_orders", lambda x: x.cast("string")), ", ")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Scope: "), "scope"),
        F.concat(F.lit("Orders analyzed: "), "orders_considered"),
        F.concat(F.lit("Late/failed rate: "), rate_text(), F.lit("%")),
        F.lit("Top causes:"),
        cause_lines,
        F.when(F.size("recommendations") > 0, F.lit("Recommendations:")),
        advice_lines,
        F.when(F.size("sample_orders") > 0, F.concat(F.lit("Sample impacted order_ids: ["), id_list, F.lit("]"))),
    )
    return insights.withColumn(
        "narrative", F.when(F.col("orders_considered") == 0, F.lit(NO_ORDERS_TEXT)).otherwise(text)
    )


def projected_late(volume: int, rate: str | Column = "late_rate") -> Column:
    """Late orders to expect in ``volume`` orders, cut to a whole number."""
    rate = F.col(rate) if isinstance(rate, str) else rate
    return F.floor(F.lit(volume) * rate / 100).cast("bigint")


def onboarding_title(client: str) -> str:
    return f"Onboarding risk outlook for {client}"


def onboarding_text(actions: Mapping[str, str] = MODEL_ACTIONS) -> Column:
    """Narrative of an insight that serves as the baseline for a new client."""
    risk_lines = F.transform(
        "top_causes",
        lambda x: F.concat(
            F.lit("- "), x["cause"], F.lit(": "), x["n"], F.lit(" occurrences | "),
            F.coalesce(action_for(x["cause"], actions), F.lit("")),
        ),
    )
    headline = F.concat(
        F.lit("Baseline late rate: "), rate_text(),
        F.lit("% | projected delayed orders per month: ~"), F.col("projected_delayed_orders"),
    )
    lines = [F.col("scope"), headline, F.lit(ONBOARDING_RISKS_TEXT), risk_lines, *map(F.lit, ONBOARDING_PLAYBOOK)]
    return F.concat_ws("\n", *lines)


def insights_with_onboarding(
    fact: DataFrame, scopes: Mapping[str, Column], client: str, volume: int = ONBOARDING_VOLUME, k: int = 5
) -> DataFrame:
    """:func:`insights` for the scopes, and in the same passes one for the whole network: the baseline for
    a new client, with the late orders to expect by the rounded late rate."""
    title = onboarding_title(client)
    is_baseline = F.col("scope") == title
    rows = insights(fact, {**scopes, title: F.lit(True)}, k)
    return rows.withColumn("projected_delayed_orders", F.when(is_baseline, projected_late(volume))).withColumn(
        "narrative", F.when(is_baseline, onboarding_text()).otherwise(F.col("narrative"))
    )


def onboarding(fact: DataFrame, client: str, volume: int = ONBOARDING_VOLUME, k: int = 5) -> DataFrame:
    """The outlook for a new client, from the whole network."""
    return insights_with_onboarding(fact, {}, client, volume, k)
