import math
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shipcause.llm.rendezvous import op5_rendezvous_shards, rendezvous_shard, shard_documents

FOLDER = "/root/testdata/sf0.001"


def check(rows, texts):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = Counter((i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = op5_rendezvous_shards(spark, FOLDER).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    check(shard_documents(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert shard_documents(no_docs).collect() == []


def test_equal_id_equal_shard(odd_docs):
    places = {}
    for r in shard_documents(odd_docs).collect():
        places.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(len(p) == 1 for p in places.values())


def test_weights_and_moves(spark):
    keys = spark.range(40_000)
    three = {0: 1.0, 1: 2.0, 2: 1.0}
    placed = keys.select(
        rendezvous_shard(F.col("id"), three).alias("old"),
        rendezvous_shard(F.col("id"), three | {3: 4.0}).alias("more"),
        rendezvous_shard(F.col("id"), {0: 1.0, 2: 1.0}).alias("less"),
    )
    n = {tuple(r[:3]): r["count"] for r in placed.groupBy("old", "more", "less").count().collect()}
    share = lambda k, s: sum(v for key, v in n.items() if key[k] == s) / 40_000
    assert abs(share(0, 1) - 0.5) < 0.02 and abs(share(1, 3) - 0.5) < 0.02 and abs(share(1, 0) - 0.125) < 0.02
    assert all(more in (old, 3) for old, more, _ in n)  # only the new shard gains
    assert all(less == old for old, _, less in n if old != 1)  # only the lost shard's records move


def winner(key, weights):
    """The definition: of all shards' bids, made from the hash of key and shard, the highest."""

    def bid(shard):
        start = 42 if key is None else xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxh64_intdigest(shard.to_bytes(4, "little"), start)
        return weights[shard] / -math.log(((h >> 11) + 0.5) / 2**53)

    return max(weights, key=bid)


def test_shards_by_definition(spark, odd_docs):
    old, grown = dict.fromkeys(range(24), 1.0), dict.fromkeys(range(25), 1.0)
    for rows in (op5_rendezvous_shards(spark, FOLDER).collect(), shard_documents(odd_docs).collect()):
        assert rows and all((r.shard, r.grown_shard) == (winner(r.doc_id, old), winner(r.doc_id, grown)) for r in rows)
    weights = {0: 1.0, 3: 2.5, 7: 0.5}
    rows = spark.range(2000).select("id", rendezvous_shard(F.col("id"), weights).alias("shard")).collect()
    assert all(r["shard"] == winner(r["id"], weights) for r in rows)
