"""Sharding by rendezvous hashing: every shard bids for every record, the highest bid wins.

A bid depends on the record's key and the shard alone, so a shard that is added takes records only for
itself, and a shard that goes leaves all other records where they are. Weighted shards bid
``weight / -ln(u)``, which gives each the share of records that its weight has in all weights.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shipcause.llm.common import kept, table, uniform

#: About so many rows are numbered together.
ROWS_PER_BUCKET = 4096


def rendezvous_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of ``key`` among ``weights`` (shard number -> weight > 0), as int.

    A NULL key has its own fixed place. Equal bids, practically impossible, go to the larger number.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("every shard needs a weight above 0")
    bids = [
        F.struct((F.lit(float(w)) / -F.log(uniform(key, F.lit(int(s))))).alias("bid"), F.lit(int(s)).alias("shard"))
        for s, w in weights.items()
    ]
    return F.array_max(F.array(*bids))["shard"]


def number_in_shards(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each shard, without sorting a whole shard in one task.

    Equal rows are counted first, so a row that repeats without end costs one entry. Entries are dealt into
    hash buckets; a bucket's first slot is a running sum over the few bucket sizes of its shard.
    """
    names = [c for c in rows.columns if c != shard]
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    entries = rows.groupBy(shard, *names).agg(F.count(F.lit(1)).alias("__n"))
    entries = entries.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    sizes = entries.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    return (
        entries.join(starts, [shard, "__bucket"])
        .select(shard, *names, "__n", first.alias("__first"))
        .select(shard, *names, "__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__i"))
        .select(*rows.columns, (F.col("__first") + F.col("__i")).alias(slot))
    )


def shard_documents(docs: DataFrame, shards: int = 24, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Places of all ``docs`` (``doc_id``, ``text``) in shards 0 to ``shards - 1`` by their ``doc_id``.

    Columns: doc_id, size (UTF-8 bytes and 8), text_crc32 (0 for NULL or empty text), law ('key'), shard,
    slot, grown_shard (the place with one more shard of weight 1). All rows stay: repeated rows get a slot
    each, a NULL id is a key like any other, an empty table gives no rows, other columns are not looked at.
    """
    weights = dict(weights or {s: 1.0 for s in range(shards)})
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), weights | {max(weights) + 1: 1.0}).alias("grown_shard"),
    )
    numbered = number_in_shards(kept(rows, "shard-places"))
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast(T.LongType()), "grown_shard")


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
