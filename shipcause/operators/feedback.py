"""Customer feedback per order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import FEEDBACK_TAGS
from shipcause.functions.values import labels_where, leading_double, try_double
from shipcause.schemas import SEQ

TEXT_SEPARATOR = " || "


def _labels_found(needles: dict[str, str]) -> Column:
    """Array of the labels for which some text of the group holds a needle.

    One boolean maximum per label instead of a collected list: the state per order has a fixed size
    however many feedback rows the order has.
    """
    text = F.lower(F.col("feedback_text"))
    hits: dict[str, Column] = {}
    for needle, label in needles.items():
        hit = text.contains(F.lit(needle))
        hits[label] = hits[label] | hit if label in hits else hit
    return labels_where({label: F.max(hits[label]) for label in sorted(hits)})


def feedback_summary_model(feedback: DataFrame, needles: Iterable[str] = ()) -> DataFrame:
    """Mean rating (a text that is no number counts as 0), alphabetically last sentiment and, for the
    rules, which of ``needles`` occur in any of the order's texts.

    The words looked for stand in the metadata of ``feedback_needles``, also in saved tables.
    """
    aggs = [
        F.avg(leading_double("rating")).alias("feedback_rating_avg"),
        F.max("sentiment").alias("feedback_sentiment_top"),
    ]
    needles = list(needles)
    if needles:
        found = _labels_found({n: n for n in needles})
        aggs.append(found.alias("feedback_needles", metadata={"words": sorted(needles)}))
    return feedback.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(*aggs)


def feedback_summary_cli(feedback: DataFrame, tags: dict[str, str] = FEEDBACK_TAGS) -> DataFrame:
    """Most frequent sentiment (NULL counts as ``Unknown``, the first met wins a tie), mean of the ratings
    that are numbers, and the sorted set of tags.

    Rows are first reduced to one per order and sentiment, then to one per order; sums and counts of the
    ratings travel along, so a single shuffle on the order serves both steps.
    """
    sentiment = F.coalesce(F.col("sentiment"), F.lit("Unknown")).alias("sentiment")
    rows = feedback.where(F.col("order_id").isNotNull())
    by_sentiment = rows.groupBy("order_id", sentiment).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(SEQ).alias("first_seen"),
        F.sum(try_double("rating")).alias("rating_sum"),
        F.count(try_double("rating")).alias("rating_n"),
        _labels_found(tags).alias("labels"),
    )
    top = F.min(F.struct((-F.col("n")).alias("minus_n"), "first_seen", "sentiment"))["sentiment"]
    found = {label: F.max(F.array_contains("labels", label)) for label in sorted(set(tags.values()))}
    return by_sentiment.groupBy("order_id").agg(
        top.alias("feedback_sentiment_top"),
        F.try_divide(F.sum("rating_sum"), F.sum("rating_n")).alias("feedback_rating_avg"),
        labels_where(found).alias("feedback_tags"),
    )


def feedback_text(feedback: DataFrame) -> DataFrame:
    """All texts of an order, lower-cased and joined in source order; a NULL text is an empty piece.

    Every order is there, and its text has to fit in one row: the job fails where one cannot.
    :func:`feedback_text_rows` has the same texts without that condition.
    """
    joined = F.expr(
        f"listagg(lower(coalesce(feedback_text, '')), '{TEXT_SEPARATOR}') within group (order by {SEQ})"
    )
    rows = feedback.where(F.col("order_id").isNotNull())
    return rows.groupBy("order_id").agg(joined.alias("feedback_text_concat"))


def feedback_text_rows(feedback: DataFrame) -> DataFrame:
    """The texts of all orders, one row per piece: order, position, lower-cased text."""
    rows = feedback.where(F.col("order_id").isNotNull())
    return rows.select("order_id", F.col(SEQ).alias("position"), F.lower(F.coalesce("feedback_text", F.lit(""))).alias("piece"))
