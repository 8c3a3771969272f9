import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcause.llm import ann_graph
from shipcause.llm.ann_graph import build_graph, nearest, op3_pruned_graph, robust_prune

FOLDER = "/root/testdata/sf0.001"


def exact(rows, queries, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in queries:
        if q in ok:
            own = min(map(tuple, ok[q]))
            d = [(min(np.sqrt(((np.array(own) - v) ** 2).sum()) for v in vs if len(v) == len(own)), i) for i, vs in ok.items()
                 if i != q and any(len(v) == len(own) for v in vs)]
            out[q] = [(i, s) for s, i in sorted(d)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann_graph, "SHARD_VECTORS", 150)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = found(op3_pruned_graph(spark, FOLDER))
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    for q, hits in got.items():
        true = dict(exact(rows, [q], k=len(rows))[q])
        assert all(s == pytest.approx(true[i], abs=1e-12) for i, s in hits)


def test_clustered_vectors(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(40, 32)) * 10
    x = (centres[random.integers(0, 40, 3000)] + random.normal(size=(3000, 32))).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(nearest(df, F.col("vec_id") % 100 == 0))
    assert recall(got, exact(list(enumerate(x.tolist())), range(0, 3000, 100))) >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(1, 40)] + [
        (0, [1.0, 2.0]), (100, [3.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [1.0, inf]), (600, [None, 1.0]),
        (700, []), (800, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (50, [1.5, 2.0]), (51, [1.5, 2.0]), (51, [1.5, 2.0]), (52, [9.0, 9.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(1))
    got = found(nearest(df, F.col("vec_id") % 100 == 0))
    assert got == {q: w for q, w in exact(rows, [0, 100, 800]).items() if w}
    assert [i for i, _ in got[0]] == list(range(1, 11))  # ties go to the smaller ids, many copies or not
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<float>")
    assert found(nearest(df, F.col("vec_id") == 0)) == {0: [(1, 1.0), (2, 3.0)]}


def test_pruned_edges_are_diverse():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [1.2, 0], [0, 2], [-3, 0]], np.float32)
    assert sorted(robust_prune(x, 0, np.arange(6)).tolist()) == [1, 4, 5]
    edges, start = build_graph(np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32))
    assert (edges >= 0).sum(axis=1).max() <= ann_graph.SLACK and (edges != np.arange(500)[:, None]).all()
    seen, todo = {start}, [start]
    while todo:
        for j in edges[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == 500  # everything can be reached


@pytest.mark.parametrize("factor,offset", [(1e25, 0.0), (1e-25, 0.0), (1.0, 1e6), (1e160, 0.0), (1e-160, 0.0)])
def test_sizes_and_offsets_of_vectors(spark, monkeypatch, factor, offset):
    monkeypatch.setattr(ann_graph, "SHARD_VECTORS", 400)
    monkeypatch.setattr(ann_graph, "SENT_QUERIES", 7)
    monkeypatch.setattr(ann_graph, "BLOCK_QUERIES", 4)
    x = np.random.default_rng(5).normal(size=(1500, 24)) * factor + offset
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(nearest(df, F.col("vec_id") % 100 == 0))
    plain = (x - offset) / factor
    want = exact(list(enumerate(plain.tolist())), range(0, 1500, 100))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    for q, hits in got.items():
        for i, score in hits:
            assert score == pytest.approx(np.sqrt(((plain[i] - plain[q]) ** 2).sum()) * factor, rel=1e-6)


def test_large_and_small_vectors_together(spark):
    random = np.random.default_rng(6)
    x = np.concatenate([random.normal(size=(400, 8)) * 1e25, random.normal(size=(400, 8)), random.normal(size=(400, 8)) * 1e-25])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(nearest(df, F.col("vec_id") % 100 == 0))
    assert recall(got, exact(list(enumerate(x.tolist())), range(0, 800, 100))) >= 0.9
