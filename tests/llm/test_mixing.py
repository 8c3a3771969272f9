import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shipcause.llm import mixing
from shipcause.llm.mixing import Mix, draws, mix_documents, op9_block_mix, permuted, source_targets

FOLDER = "/root/testdata/sf0.001"


def targets(sizes):
    """Shares by weight, again and again for what is over three times a source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    got, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            got[s] += left * weight[s] / total
            if got[s] >= 3 * sizes[s]:
                over += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                open_.discard(s)
        left = over
    return got


def check(rows, docs):
    words = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs]
    sizes = defaultdict(int)
    for _, s, n in words:
        sizes[s] += n
    want, taken = targets(sizes), defaultdict(int)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in rows) == sorted((str(i), str(s), n) for i, s, n in words)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    return want, taken


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = Mix(docs).taken().collect()
    want, taken = check(rows, docs.collect())
    assert all(abs(taken[s] - t) <= 96 + 0.02 * t for s, t in want.items())
    again = op9_block_mix(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(odd_docs, no_docs):
    check(Mix(odd_docs).taken().collect(), odd_docs.collect())
    assert Mix(no_docs).taken().collect() == []
    assert mix_documents(no_docs).collect() == []


def test_full_sources_and_one_hot_source(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 5, "a").when(F.col("id") < 390, "b").otherwise("c").alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
    )
    want, taken = check(Mix(docs).taken().collect(), docs.collect())
    assert want["a"] == 3 * 15 == taken["a"]
    assert all(abs(taken[s] - t) <= 96 + 0.01 * t for s, t in want.items())


def test_blocks_come_again_only_after_all_others(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mix = Mix(docs, block_words=16, shard_blocks=512)
    slots = mix.slots().collect()
    places, times = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in slots:
        places[r.shard].append(r.slot)
        times[r.source_no][r.block] += 1
    assert len(places) > 2 and all(sorted(p) == list(range(len(p))) for p in places.values())
    size = {r.source_no: r.source_size for r in mix.targets.collect()}
    for s, counts in times.items():
        every = [counts.get(b, 0) for b in range(-(-size[s] // 16))]
        assert max(every) - min(every) <= 1 and sum(every) == sum(counts.values())
    spread = [len({r.source_no for r in slots if r.shard == 0 and r.slot < 60})]
    assert spread[0] > 5  # sources are mixed within a shard
    words = mix.contents().agg(F.sum("words")).first()[0]
    assert words == mix.taken().agg(F.sum("taken")).first()[0]


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))
    assert sum(r.id == r.p for r in rows) < 30


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = mix_documents(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r for r in Mix(docs).taken().collect()}
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        if r.size:
            assert r.taken // r.size <= copies.get(i, 0) <= -(-r.taken // r.size)


def test_counts_are_drawn(spark):
    """A shard's count of a source is hypergeometric: its mean and variance over many seeds are those of the law."""
    rows = [(f"s{i}", i, size, float(size)) for i, size in enumerate((32_000, 16_000, 8_000, 3_200))]
    targets = spark.createDataFrame(rows, "source string, source_no long, source_size long, target double")
    total, size = 1850, 185
    found = defaultdict(list)
    for seed in range(25):
        counts = {(r.shard, r.source_no): r["count"] for r in draws(targets, 32, 185, 3, seed).collect()}
        for shard in range(10):
            assert sum(counts.get((shard, s), 0) for s in range(4)) == size
        for s, (_, _, words, _) in enumerate(rows):
            assert sum(counts.get((shard, s), 0) for shard in range(10)) == words // 32
            found[s] += [counts.get((shard, s), 0) for shard in range(10)]
    for s, (_, _, words, _) in enumerate(rows):
        share = words / 32 / total
        law = size * share * (1 - share) * (total - size) / (total - 1)
        mean = sum(found[s]) / len(found[s])
        variance = sum((x - size * share) ** 2 for x in found[s]) / len(found[s])
        assert mean == pytest.approx(size * share) and 0.6 * law < variance < 1.6 * law


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1000)
    docs = spark.range(100_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("site"), "id").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text")
    )
    rows = Mix(docs, shard_blocks=4096).taken().agg(F.count(F.lit(1)), F.max(F.col("taken") - 3 * F.col("size")), F.max(F.abs(F.col("taken") - F.col("target")))).first()
    assert rows[0] == 100_000 and rows[1] <= 0 and rows[2] <= 64


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_stretches_and_targets(spark, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    sizes = {**{f"s{i}": 37 * (i * i % 19) for i in range(23)}, None: 500, "": 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = source_targets(df)
    want = targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got.collect())
    counts = draws(got, 8, 64, 3, 5).collect()
    slots = defaultdict(int)
    for r in counts:
        slots[r.shard] += r["count"]
    assert len(set(list(slots.values())[:-1])) <= 2 and max(slots.values()) <= 64 and sorted(slots) == list(range(len(slots)))
