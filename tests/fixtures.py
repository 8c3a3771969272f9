"""Small hand-made tables: give the rows that matter, the rest is empty."""

from __future__ import annotations

import datetime as dt

from shipcause.schemas import SEQ, TABLE_SCHEMAS

LOGS = ["raw_fleet_logs", "raw_warehouse_logs", "raw_external_factors", "raw_feedback"]


def at(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text) if text else None


def table(spark, name: str, rows: list[dict]):
    """A table from dicts; absent columns are NULL, texts in time columns are parsed, logs are numbered."""
    spec = dict(TABLE_SCHEMAS[name])
    if name in LOGS:
        spec[SEQ] = "bigint"
        rows = [{SEQ: i, **r} for i, r in enumerate(rows)]
    values = [
        tuple(at(r.get(c)) if t == "timestamp_ntz" and isinstance(r.get(c), str) else r.get(c) for c, t in spec.items())
        for r in rows
    ]
    return spark.createDataFrame(values, ", ".join(f"{c} {t}" for c, t in spec.items()))


def tables(spark, **rows: list[dict]) -> dict:
    return {name: table(spark, name, rows.get(name, [])) for name in TABLE_SCHEMAS}
