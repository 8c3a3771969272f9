"""Free-text questions: which template answers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipcause.fixed import FALLBACK_REASON, FALLBACK_ROUTE, ROUTE_REASONS

# Template -> words, tried in order; every group of words needs one hit.
ROUTES = [
    ("city_vs_city_last_month", [["compare", "vs"], ["city"]]),
    ("warehouse_august_reasons", [["warehouse"], ["aug", "month", "reason"]]),
    ("client_failures_past_week", [["client"], ["fail", "failed", "week"]]),
    ("festival_period_risks", [["festival", "peak", "holiday"]]),
    ("client_onboarding_risk", [["onboard", "20,000", "risk"]]),
    ("city_delayed_date_range", [["city"], ["yesterday", "date range", "delay", "delayed"]]),
]


def route_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """Add ``template_id`` and ``reason`` to a table of questions; the first route that fits wins."""
    text = F.lower(F.trim(question))

    def fits(groups: list[list[str]]) -> Column:
        condition = F.lit(True)
        for words in groups:
            hit = F.lit(False)
            for word in words:
                hit = hit | text.contains(word)
            condition = condition & hit
        return condition

    template, reason = F.lit(FALLBACK_ROUTE), F.lit(FALLBACK_REASON)
    for name, groups in reversed(ROUTES):
        template = F.when(fits(groups), F.lit(name)).otherwise(template)
        reason = F.when(fits(groups), F.lit(ROUTE_REASONS[name])).otherwise(reason)
    return df.withColumns({"template_id": template, "reason": reason})
