"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of bounded size by a hash. In each shard a graph is built in one pass: for every
new vector a beam search in the graph so far proposes neighbours, and pruning keeps those that are not much
closer to a neighbour already kept than to the vector itself (relaxed by ALPHA), so that edges point in different
directions and some of them far. A query goes through the graph of every shard with a beam search; its nearest
vectors are ranked by their exact distance, and the shards' answers are merged.

Equal vectors are one node that stands for the smallest ids among them, so copies cost nothing and ties come out
right.

All distances are in double precision, of vectors scaled by a power of two so that no square leaves its range:
vectors of any size, or with a large common offset, are told apart as long as doubles do. Only where sizes within
one table differ by factors beyond 1e150 may neighbours be missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipcause.llm.common import kept, ship_package, table

#: Vectors of a shard; queries that one copy of a shard's graph is sent for, and those searched at once.
SHARD_VECTORS, SENT_QUERIES, BLOCK_QUERIES = 16_384, 4096, 256
#: Edges kept when pruning and allowed before the next pruning; beams when building and searching.
DEGREE, SLACK, BUILD_BEAM, SEARCH_BEAM = 32, 48, 64, 192
ALPHA = 1.2
#: Vectors expanded at a time per search.
WIDTH = 4


# ---- one shard's graph, inside a task -----------------------------------------------


def exponent(x: np.ndarray) -> int:
    """Of the power of two that brings all of ``x`` within -1 and 1."""
    return int(np.frexp(np.abs(x).max(initial=0.0))[1])


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances of ``point`` to the rows of ``x``; those whose squares leave the range are scaled first."""
    difference = x - point
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((difference**2).sum(axis=1))
    for i in np.flatnonzero(~np.isfinite(out) | (out < 1e-150)):
        e = exponent(difference[i])
        out[i] = np.ldexp(np.sqrt((np.ldexp(difference[i], -e) ** 2).sum()), e)
    return out


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Nodes found for each query, nearest first, with squared distances, and all nodes expanded on the way.

    ``edges`` has the neighbours of each node in a row, filled up with -1. Unused places hold -1 and infinity.
    """
    b = len(queries)
    rows = np.arange(b)[:, None]
    found = np.full((b, beam), -1, np.int32)
    far = np.full((b, beam), np.inf, x.dtype)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, len(x) + 1), bool)  # the last column takes the places that are not used
    seen[:, -1] = seen[:, start] = True
    found[:, 0], far[:, 0], done[:, 0] = start, ((x[start] - queries) ** 2).sum(axis=1), False
    visited = []
    while not done.all():
        pick = np.argsort(np.where(done, np.inf, far), axis=1, kind="stable")[:, :WIDTH]
        node = np.where(done[rows, pick], -1, found[rows, pick])
        visited.append((node, far[rows, pick]))
        done[rows, pick] = True
        new = np.where(node[:, :, None] >= 0, edges[node], -1).reshape(b, -1)
        order = np.argsort(new, axis=1)
        new = new[rows, order]
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1  # met under two nodes at once
        new[seen[rows, new]] = -1
        seen[rows, new] = True
        d = np.full(new.shape, np.inf, x.dtype)
        r, c = np.nonzero(new >= 0)
        d[r, c] = ((x[new[r, c]] - queries[r]) ** 2).sum(axis=1)
        all_far = np.concatenate([far, d], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        found = np.concatenate([found, new], axis=1)[rows, best]
        far = all_far[rows, best]
        done = np.concatenate([done, d == np.inf], axis=1)[rows, best]
    return found, far, visited


def robust_prune(x: np.ndarray, point: int, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE of the candidates: the nearest first, then those it does not shield."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates >= 0) & (candidates != point)]
    v = x[candidates] - x[point]  # from the point itself, so a common offset costs no digits below
    own = (v * v).sum(axis=1)
    order = np.argsort(own, kind="stable")
    candidates, own, v = candidates[order], own[order], v[order]
    between = own[:, None] + own[None, :] - 2 * v @ v.T
    open_ = np.ones(len(candidates), bool)
    chosen: list[int] = []
    for i in range(len(candidates)):
        if open_[i]:
            chosen.append(i)
            if len(chosen) == DEGREE:
                break
            open_ &= ALPHA * ALPHA * between[i] > own
    return candidates[chosen].astype(np.int32)


def build_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges and start node of a graph over ``x`` (distinct rows)."""
    n = len(x)
    start = int(((x - np.median(x, axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, SLACK), -1, np.int32)
    degree = np.zeros(n, np.int32)
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    at = 0
    while at < len(order):
        batch = order[at : at + max(1, min(256, at // 8))]  # searched together in the graph so far
        at += len(batch)
        found, _, visited = beam_search(x, edges, start, x[batch], BUILD_BEAM)
        proposals = np.concatenate([found, *[node for node, _ in visited]], axis=1)
        back: dict[int, list[int]] = {}
        for k, p in enumerate(batch.tolist()):
            near = robust_prune(x, p, proposals[k])
            edges[p, : len(near)], degree[p] = near, len(near)
            for q in near.tolist():
                back.setdefault(q, []).append(p)
        for q, sources in back.items():
            if degree[q] + len(sources) <= SLACK:
                edges[q, degree[q] : degree[q] + len(sources)] = sources
                degree[q] += len(sources)
            else:
                near = robust_prune(x, q, np.concatenate([edges[q, : degree[q]], np.array(sources, np.int32)]))
                edges[q], degree[q] = -1, len(near)
                edges[q, : len(near)] = near
    return edges, start


# ---- Spark ----------------------------------------------------------------------


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (array of double): rows with an id and a vector that is neither empty, nor zero, nor
    holds anything NULL or not finite."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def build_index(vectors: DataFrame, ids_kept: int, shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, int]:
    """One row per shard with its vectors, ids and graph, and the number of shards.

    Of equal vectors the ``ids_kept`` smallest ids are kept: no answer of fewer neighbours can hold another.
    Vectors of different lengths never meet.
    """
    copies = Window.partitionBy("v").orderBy("vec_id")
    nodes = vectors.withColumn("r", F.dense_rank().over(copies)).filter(F.col("r") <= ids_kept)
    nodes = kept(nodes.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // shard_vectors))
    nodes = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy())
        edges, start = build_graph(np.ldexp(x, -exponent(x)))
        ends = np.cumsum([len(i) for i in part["ids"]])
        ids = np.concatenate(part["ids"].to_numpy()).astype(np.int64)
        blobs = [a.tobytes() for a in (x, edges, ids, ends.astype(np.int64))]
        return pd.DataFrame([(int(part["dim"].iloc[0]), int(part["shard"].iloc[0]), start, *blobs)], columns=names)

    names = ["dim", "shard", "start", "x", "edges", "ids", "ends"]
    schema = "dim int, shard int, start int, x binary, edges binary, ids binary, ends binary"
    return kept(nodes.groupBy("dim", "shard").applyInPandas(build, schema), "graphs"), shards


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``vec_id`` and ``score`` of the k nearest per query and shard.

    Queries go in blocks to every shard: a group is one shard and one block of queries, a few megabytes each.
    """
    blocks = max(1, -(-queries.count() // SENT_QUERIES))
    sent = (
        queries.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("v")).alias("q"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def search(pair: pd.DataFrame) -> pd.DataFrame:
        row = pair.iloc[0]
        x = np.frombuffer(row.x, np.float64).reshape(-1, row.dim)
        edges = np.frombuffer(row.edges, np.int32).reshape(len(x), -1)
        ids, ends = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ends, np.int64)
        q = np.asarray(row.q, np.float64).reshape(-1, row.dim)
        e = exponent(x)
        scaled, scaled_q = np.ldexp(x, -e), np.ldexp(q, -e)
        out = []
        for at in range(0, len(q), BLOCK_QUERIES):
            found, _, _ = beam_search(scaled, edges, int(row.start), scaled_q[at : at + BLOCK_QUERIES], SEARCH_BEAM)
            for query_id, vector, nodes in zip(row.query_ids[at:], q[at:], found, strict=False):
                nodes = nodes[nodes >= 0]
                score = distances(x[nodes], vector)
                hits = []
                for i in np.argsort(score, kind="stable"):
                    if len(hits) > k and score[i] > hits[-1][2]:
                        break  # ties with the last one stay in
                    mine = ids[ends[nodes[i] - 1] if nodes[i] else 0 : ends[nodes[i]]]
                    hits.extend((query_id, v, score[i]) for v in mine.tolist() if v != query_id)
                out.extend(sorted(hits, key=lambda h: (h[2], h[1]))[:k])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    pairs = sent.join(index.hint("merge"), ["dim", "shard"])
    return pairs.groupBy("dim", "shard", "block").applyInPandas(search, "query_id bigint, vec_id bigint, score double")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean) of the k nearest of each query.

    Queries are the rows of ``embeddings`` (``vec_id``, ``embedding``) that ``is_query`` holds for, candidates all
    rows but those with the query's own id; ties go to the smaller id. Repeated rows count once; where an id comes
    with several vectors, all are candidates, the best of them once, and the smallest is the query. Vectors that
    are NULL, empty, zero or not finite take no part, nor do rows without id. Fewer candidates give fewer rows, an
    empty table none. Other columns are not looked at.
    """
    ship_package(embeddings.sparkSession)
    vectors = usable_vectors(embeddings)
    queries = kept(vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    index, shards = build_index(vectors, ids_kept=k + 1)
    hits = search_index(index, shards, queries, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
