"""One row per key.

Every operator here is a plain aggregate, so Spark reduces each key inside the map tasks before the
shuffle: a key that holds a third of the table sends at most one row per map task. Being aggregates,
they also tell Catalyst that the key is unique, which lets it drop a left join whose columns nobody reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import TRAFFIC_SCORES
from shipcause.functions.values import column
from shipcause.schemas import SEQ


def place(df: DataFrame, order: Sequence[str | Column]) -> Column:
    """What ``order`` compares, ascending and NULL first: a position that is one integer, else a struct."""
    if len(order) == 1 and isinstance(order[0], str) and df.schema[order[0]].dataType.typeName() in ("long", "integer"):
        return F.coalesce(F.col(order[0]).cast("bigint"), F.lit(-(2**63)))
    return F.struct(*[column(c).alias(f"rank{i}") for i, c in enumerate(order)])


def first_row_per_key(
    df: DataFrame, key: str, order: Sequence[str | Column], columns: Sequence[str | Column]
) -> DataFrame:
    """``columns`` of the row that comes first by ``order`` (ascending, NULL first); NULL keys are left out."""
    best = F.min_by(F.struct(*columns), place(df, order)).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "best.*")


def first_value_per_key(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """For each column on its own, the first value by ``order`` that is not NULL."""
    at = place(df, [order])

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)

    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[first(c) for c in columns])


def traffic_score(c: str | Column = "traffic_condition", ignore_case: bool = True) -> Column:
    """Severity of a traffic condition; 0 for any other text and for NULL."""
    c = F.lower(column(c)) if ignore_case else column(c)
    score = F.lit(0)
    for name, value in TRAFFIC_SCORES.items():
        score = F.when(c == F.lit(name.lower() if ignore_case else name), F.lit(value)).otherwise(score)
    return score


def worst_factor(factors: DataFrame, preset: str = "model", key: str = "order_id") -> DataFrame:
    """The external factor with the heaviest traffic; among equals the earliest one.

    ``model`` scores without regard to case and takes a NULL time as earliest; ``cli`` scores the exact
    words and takes a NULL time as latest.
    """
    model = preset == "model"
    scored = factors.withColumn("traffic_score", traffic_score(ignore_case=model))
    order = [-F.col("traffic_score"), F.col("recorded_at"), F.col(SEQ)]
    if not model:
        order.insert(1, F.col("recorded_at").isNull())
    return first_row_per_key(
        scored, key, order, ["traffic_condition", "weather_condition", "event_type", "traffic_score"]
    )
