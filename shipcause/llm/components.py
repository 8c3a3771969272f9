"""Connected components of a graph by alternating star operations, in Spark alone.

A large star hangs all larger neighbours of a node on the smallest node next to it, a small star the smaller
ones. Both keep components as they are, and repeated they leave one star around the smallest node of each,
after about log(n) steps. Each step is a grouped minimum, taken in the map tasks first, and a join of edges with
the minima; edges are written to the shared folder after each round, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipcause.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.filter("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``edges`` (``a``, ``b``).

    Direction, repeated edges, loops and edges with a NULL end make no difference; no edges give no rows.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = kept(pairs, "edges")
    state = None
    while state != (state := pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()):
        pairs = kept(_small_star(_large_star(pairs)), "edges")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
