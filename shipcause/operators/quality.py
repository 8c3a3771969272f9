"""Data checks on the input tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shipcause.fixed import DATE_COLUMNS
from shipcause.functions.dates import try_timestamp
from shipcause.functions.values import null_if_missing
from shipcause.schemas import TABLE_KEYS, TABLE_SCHEMAS

Tables = Mapping[str, DataFrame]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_keys(tables: Tables) -> DataFrame:
    """Rows without key, per table."""
    return _union(
        [
            tables[t]
            .agg(F.count_if(F.col(key).isNull()).alias("null_keys"))
            .select(F.lit(t).alias("table_name"), F.lit(key).alias("key_name"), "null_keys")
            for t, key in TABLE_KEYS.items()
            if t in tables
        ]
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with the number of rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def invalid_dates(raw: DataFrame, table: str) -> DataFrame:
    """Texts in date columns that are no date, per column; ``raw`` holds the columns as text."""
    names = [c for c in DATE_COLUMNS[table] if c in raw.columns]
    counts = raw.agg(
        *[
            F.count_if(null_if_missing(c).isNotNull() & try_timestamp(c).isNull()).alias(c)
            for c in names
        ]
    )
    return counts.unpivot([], names, "column_name", "invalid_dates").withColumn("table_name", F.lit(table))


# Which key of a table has to exist where.
REFERENCES = [
    ("raw_orders", "client_id", "dim_clients"),
    ("raw_warehouse_logs", "order_id", "raw_orders"),
    ("raw_warehouse_logs", "warehouse_id", "dim_warehouses"),
    ("raw_fleet_logs", "order_id", "raw_orders"),
    ("raw_fleet_logs", "driver_id", "dim_drivers"),
    ("raw_external_factors", "order_id", "raw_orders"),
    ("raw_feedback", "order_id", "raw_orders"),
]


def orphan_keys(tables: Tables) -> DataFrame:
    """Keys without counterpart: distinct keys and rows, per reference.

    Keys are counted before the join, so a key that fills a third of a log is one row in it.
    """

    def orphans(table: str, key: str, target: str) -> DataFrame:
        keys = tables[table].where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
        return (
            keys.join(tables[target].select(key), key, "left_anti")
            .agg(F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_rows"))
            .select(
                F.lit(table).alias("table_name"), F.lit(key).alias("key_name"), F.lit(target).alias("target"),
                "orphan_keys", "orphan_rows",
            )
        )

    return _union([orphans(*r) for r in REFERENCES if r[0] in tables and r[2] in tables])


def schema_log(tables: Tables) -> DataFrame:
    """(table_name, column_name, declared, found, rejected) for every declared column of ``tables``.

    ``found`` is the type as loaded, NULL where the column is missing; ``rejected`` counts the values that are not
    missing and cannot become the declared type, so a text column of good numbers has none.
    """
    logs = []
    for table, df in tables.items():
        types = dict(df.dtypes)
        bad = {
            c: F.count_if(null_if_missing(F.col(c).cast("string")).isNotNull() & F.col(c).try_cast(declared).isNull())
            for c, declared in TABLE_SCHEMAS[table].items()
            if c in types and types[c] != declared  # no value of the declared type is rejected
        }
        bad = {c: F.count_if(F.lit(False)) for c in types} | bad
        rows = [
            F.struct(
                F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(declared).alias("declared"),
                F.lit(types.get(c)).cast("string").alias("found"), bad.get(c, F.lit(None)).cast("bigint").alias("rejected"),
            )
            for c, declared in TABLE_SCHEMAS[table].items()
        ]
        logs.append(df.agg(F.array(*rows).alias("log")).select(F.inline("log")))
    return _union(logs)


def schema_problems(tables: Tables) -> list[tuple[str, str, str]]:
    """(table, column, problem) for columns that are missing or of another type than specified."""
    out = []
    for table, spec in TABLE_SCHEMAS.items():
        if table not in tables:
            out.append((table, "", "table missing"))
            continue
        found = {f.name: f.dataType.simpleString() for f in tables[table].schema.fields}
        for name, wanted in spec.items():
            if name not in found:
                out.append((table, name, "missing"))
            elif found[name] != wanted:
                out.append((table, name, f"{found[name]} instead of {wanted}"))
    return out


def schema_report(tables: Tables) -> DataFrame:
    """:func:`schema_problems` as rows; only metadata is read."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(schema_problems(tables), "table_name string, column_name string, problem string")
