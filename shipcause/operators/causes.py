"""Cause rules as data, compiled to one array expression per order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import (
    BAD_WEATHER,
    DISPATCH_LAG_MINUTES_LIMIT,
    FEEDBACK_TAGS,
    MODEL_ACTIONS,
    MODEL_DEFAULT_ACTION,
    PICKING_MINUTES_LIMIT,
    UNKNOWN_ACTION,
    UNKNOWN_CAUSE,
)
from shipcause.functions.values import labels_where

TEXT = "text"  # stands for all text fields of an order together
FEEDBACK = "feedback"  # tells whether a word occurs in any of the order's feedback texts


@dataclass(frozen=True)
class Rule:
    """``cause`` holds when ``test`` holds for ``column``. Rules with the same cause are alternatives."""

    cause: str
    test: str
    column: str
    value: object = None

    def holds(self, fields: Mapping[str, Column | Callable[[str], Column]]) -> Column:
        c = fields[self.column]
        if self.test == "contains":
            found = c.contains(F.lit(self.value))
            if FEEDBACK in fields:
                found = found | fields[FEEDBACK](self.value)
            return found
        if self.test == "over":
            return c > F.lit(self.value)
        if self.test == "at_least":
            return c >= F.lit(self.value)
        if self.test == "one_of":
            return c.isin(*self.value)
        if self.test == "not_empty":
            return c != F.lit("")
        if self.test == "not_blank":
            return c.rlike(r"(?U)\S")
        if self.test == "is_true":
            return c.cast("boolean")
        if self.test == "tagged":
            return F.array_contains(c, self.value)
        raise ValueError(f"unknown test {self.test!r}")


# The rules that both presets share, the model's own and the CLI's own.
SHARED_RULES = [
    Rule("stockout", "contains", TEXT, "stock"),
    Rule("warehouse_delay", "contains", TEXT, "slow"),
    Rule("warehouse_delay", "over", "picking_minutes", PICKING_MINUTES_LIMIT),
    Rule("dispatch_lag", "over", "dispatch_lag_minutes", DISPATCH_LAG_MINUTES_LIMIT),
    Rule("address_issue", "contains", TEXT, "address"),
    Rule("vehicle_issue", "contains", TEXT, "breakdown"),
    Rule("traffic", "contains", TEXT, "congestion"),
    Rule("traffic", "at_least", "traffic_score", 1),
    Rule("weather", "one_of", "weather_condition", tuple(BAD_WEATHER)),
    Rule("late_delivery", "is_true", "is_late"),
]
MODEL_RULES = [
    *SHARED_RULES,
    Rule("event", "not_blank", "event_type"),
    Rule("poor_comm", "contains", TEXT, "update"),
]
CLI_RULES = [
    *SHARED_RULES,
    Rule("event", "not_empty", "event_type"),
    *[Rule(tag, "tagged", "feedback_tags", tag) for tag in sorted(set(FEEDBACK_TAGS.values()))],
]

MODEL_TEXT_FIELDS = ["failure_reason", "gps_delay_notes", "warehouse_notes"]
CLI_TEXT_FIELDS = ["failure_reason", "gps_delay_notes", "notes"]


def needles(rules: Iterable[Rule]) -> list[str]:
    """The words that the rules look for in texts."""
    return sorted({r.value for r in rules if r.test == "contains"})


def rule_columns(rules: Iterable[Rule], text_fields: Iterable[str]) -> list[str]:
    """The fact columns that the rules read."""
    return sorted({r.column for r in rules if r.column != TEXT} | set(text_fields))


def text_blob(fields: Iterable[str]) -> Column:
    """The fields that are not NULL, lower-cased and joined by a space."""
    return F.lower(F.concat_ws(" ", *fields))


def feedback_holds(fact: DataFrame) -> Callable[[str], Column] | None:
    """How to ask whether a word occurs in an order's feedback; None for a fact without feedback.

    The words that ``feedback_needles`` was made for are looked up there, others in the joined text. A word
    that neither covers is an error, not an absence.
    """
    names = {f.name: f for f in fact.schema.fields}
    if not names.keys() & {"feedback_needles", "feedback_text_concat"}:
        return None
    covered = names["feedback_needles"].metadata.get("words", []) if "feedback_needles" in names else []

    def holds(word: str) -> Column:
        if word in covered:
            return F.coalesce(F.array_contains("feedback_needles", word), F.lit(False))
        if "feedback_text_concat" in names:
            return F.coalesce(F.col("feedback_text_concat").contains(F.lit(word)), F.lit(False))
        raise ValueError(f"the fact does not tell whether feedback holds {word!r}; it was built for {covered}")

    return holds


def cause_conditions(rules: Sequence[Rule], fields: Mapping[str, Column]) -> dict[str, Column]:
    """One condition per cause, by cause name. A NULL condition counts as not met."""
    out: dict[str, Column] = {}
    for rule in rules:
        holds = rule.holds(fields)
        out[rule.cause] = out[rule.cause] | holds if rule.cause in out else holds
    return {cause: out[cause] for cause in sorted(out)}


def infer_causes(
    fact: DataFrame,
    rules: Sequence[Rule] = MODEL_RULES,
    text_fields: Sequence[str] = MODEL_TEXT_FIELDS,
    unknown: str | None = UNKNOWN_CAUSE,
) -> DataFrame:
    """Add ``causes``: the sorted array of distinct causes of a row.

    Without any cause it is ``[unknown]``, or empty when ``unknown`` is None. Feedback texts take part
    through ``feedback_needles`` (which words occur in any text of the order) or ``feedback_text_concat``.
    """
    fact = fact.withColumn("_text", text_blob(text_fields))
    fields = {c: F.col(c) for c in fact.columns} | {TEXT: F.col("_text")}
    if said := feedback_holds(fact):
        fields[FEEDBACK] = said
    fact = fact.withColumn("causes", labels_where(cause_conditions(rules, fields))).drop("_text")
    if unknown is None:
        return fact
    return fact.withColumn(
        "causes", F.when(F.size("causes") == 0, F.array(F.lit(unknown))).otherwise(F.col("causes"))
    )


def infer_causes_cli(fact: DataFrame, rules: Sequence[Rule] = CLI_RULES) -> DataFrame:
    """Feedback takes part through ``feedback_tags`` alone."""
    return infer_causes(fact, rules, CLI_TEXT_FIELDS, unknown=None)


def action_for(
    cause: str | Column, actions: Mapping[str, str], default: str | None = None, **extra: str
) -> Column:
    """The action listed for a cause, else ``default``; NULL when there is neither."""
    cause = F.col(cause) if isinstance(cause, str) else cause
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable({**actions, **extra}.items())])
    found = table[cause]
    return found if default is None else F.coalesce(found, F.lit(default))


def explode_causes(
    fact: DataFrame,
    actions: Mapping[str, str] = MODEL_ACTIONS,
    default: str = MODEL_DEFAULT_ACTION,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per order and cause, with the recommended action.

    ``keep_empty`` keeps an order without causes, with a NULL cause.
    """
    # The outer form spares evaluating the array a second time in a filter on its size.
    rows = fact.select("order_id", F.explode_outer("causes").alias("cause"))
    if not keep_empty:
        rows = rows.where(F.col("cause").isNotNull())
    known = action_for("cause", actions, default, **{UNKNOWN_CAUSE: UNKNOWN_ACTION})
    return rows.withColumn("recommendation", F.when(F.col("cause").isNotNull(), known))


def distinct_recommendations(causes: DataFrame) -> DataFrame:
    """Every (cause, recommendation) in use, ``unknown`` apart, by cause."""
    return (
        causes.where(F.col("cause") != UNKNOWN_CAUSE).select("cause", "recommendation").distinct().orderBy("cause")
    )
