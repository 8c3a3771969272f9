"""Joins that do not end in one task where a key is missing or very common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

#: A key with more than this part of the rows is common; there are less than its inverse.
COMMON = 1 / 200
#: Rows of common keys, and of none, are dealt out over so many buckets.
BUCKETS = 1000


def with_key(rows: DataFrame, key: str, joins: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``joins``, left joins on ``key``, for the rows that have one; the others are set aside and get NULLs.

    Rows without key would all be sent to the same task of every join, where they match nothing.
    """
    matched = joins(rows.where(F.col(key).isNotNull()))
    added = [f for f in matched.schema.fields if f.name not in rows.columns]
    if not added:
        return joins(rows)
    without = rows.where(F.col(key).isNull())
    return matched.unionByName(without.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]))


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark's estimate of ``df`` is within what it broadcasts by itself."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def join_dimension(rows: DataFrame, dim: DataFrame, key: str, measured: DataFrame, common: float = COMMON) -> DataFrame:
    """``rows`` left-joined with ``dim`` (unique ``key``), whatever part of the rows one key has.

    A dimension that Spark broadcasts is joined as it is. For a larger one, the keys that hold more than ``common`` of the
    rows of ``measured`` (the table that ``key`` comes from) are looked up: there are at most 1 / ``common`` of them,
    and their dimension rows are broadcast. Their rows, and those without key, then take part in the shuffle under
    a second key that spreads them out and finds nothing.
    """
    if is_broadcast(dim):
        return rows.join(dim, key, "left")
    values = [c for c in dim.columns if c != key]
    counts = measured.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = measured.agg(F.count(F.lit(1))).scalar()
    hot = dim.join(F.broadcast(counts.where(F.col("__n") > total * common).select(key)), key, "left_semi")
    hot = hot.select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    alone = F.col("__hot").isNotNull() | F.col(key).isNull()
    bucket = F.pmod(F.xxhash64(*rows.columns), F.lit(BUCKETS))
    met = met.withColumn("__bucket", F.when(alone, bucket).otherwise(F.lit(-1)))
    one_place = F.pmod(F.xxhash64(key), F.lit(1)) - 1  # -1, but no constant, which Spark would take out of the join's keys
    cold = dim.select(F.col(key).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in values], one_place.alias("__at"))
    met = met.join(cold, (F.col(key) == F.col("__cold")) & (F.col("__bucket") == F.col("__at")), "left")
    found = [F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in values]
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *found)
