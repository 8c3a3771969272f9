"""Mixing sources to target weights, in blocks of words.

1. Every source is packed: its documents' words follow each other in one stream, cut into blocks of a fixed
   number of words (the last one may be shorter).
2. The output consists of shards of equal size. Every source has as many slots as its target asks for, and each
   shard draws its slots from those of all sources without putting any back: how many it takes from every source
   is a multinomial draw, given that each source's total over all shards meets its target.
3. The slots of a source are numbered over all shards. Slot j is round j div n over the source's n blocks, and
   j mod n goes through that round's own pseudorandom permutation of 0 to n - 1, so a block comes again only
   after all others have come.
4. Blocks are joined to slots by source and block number.

Everything random is a hash of a seed, so reruns agree. Nothing is ever sorted or numbered for a whole source
in one task: documents are dealt into hash chunks, and running sums go over the chunk sizes. Sources may be many:
they are numbered by ranges, and running sums over them go by stretches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipcause.llm.common import WORD, free_name, kept, table, uniform
from shipcause.llm.numbering import numbered

WEIGHTS = (5, 2, 1)
#: A document comes at most so many times.
MOST = 3
BLOCK_WORDS = 32
SHARD_BLOCKS = 1 << 16
DOCS_PER_CHUNK = 1024
SLOTS_PER_TASK = 1 << 17
#: Rounds of a permutation within a shard or source, and of the one that deals all slots to shards.
ROUNDS, DRAW_ROUNDS = 10, 24
#: Running sums over sources: one task for so many neighbours, and one for the stretches' totals.
STRETCH = 4096
#: Up to so many sources their table (100 bytes a row) is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 10_000


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 to n - 1 chosen by ``key``.

    Swap-or-not: each round pairs x with k - x modulo n and swaps the two or leaves them, by a hash of the
    larger one. Every round is a permutation for any n.
    """

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, partner)) % 2 == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), swap)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_no``, ``source_size``, ``target``: one row per source of ``sizes`` (source, size).

    Sources by code point, NULL last, have the weights in turn and share all words. A target stops at ``most``
    times its source; what is over goes to the others by weight. That is one level L with
    target = min(most * size, L * weight). Each pass over the sources sets L to what the full ones leave, shared
    by weight, and ends when no more are full; a pass brings three sums to the driver.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = numbered(rows.select("*", F.col("source").isNull().alias("last"), F.lit(0).alias("all")), "all", ["last", "source"], "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = kept(rows.select("source", "source_no", "source_size", weight.alias("weight")), "mix-sources")
    cap, level, full = F.col("source_size") * float(most), 0.0, -1
    while True:
        reached = cap <= F.lit(level) * F.col("weight")
        words, held, rest, n = rows.agg(
            F.sum("source_size"), F.sum(F.when(reached, cap).otherwise(0.0)), F.sum(F.when(reached, 0.0).otherwise(F.col("weight"))),
            F.count_if(reached),
        ).first()
        if not rest or n == full:
            break
        level, full = (words - held) / rest, n
    return rows.select("source", "source_no", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``i`` from 0 to ``count`` - 1 each.

    Few rows become many here: they are dealt out by how many there will be, which no estimate of Spark tells.
    """
    tasks = max(1, -(-(rows.agg(F.sum("count")).first()[0] or 0) // SLOTS_PER_TASK))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / SLOTS_PER_TASK))
    rows = rows.withColumn("part", F.explode(parts)).repartition(tasks, *keys, "part")
    high = F.least(F.col("count"), (F.col("part") + 1) * SLOTS_PER_TASK) - 1
    return rows.withColumn("i", F.explode(F.sequence(F.col("part") * SLOTS_PER_TASK, high))).drop("part")


def draws(targets: DataFrame, block: int, shard_blocks: int, most: int, seed: int) -> DataFrame:
    """``shard``, ``source_no``, ``n`` (the source's blocks) and ``count``, how many the shard takes of them.

    All slots of all sources go through one pseudorandom permutation, which is cut into shards.
    """
    blocks = F.ceil(F.col("source_size") / block)
    # a slot stands for an average block of its source
    wanted = F.round(F.col("target") * blocks / F.col("source_size"))
    rows = targets.filter("source_size > 0").select(
        "source_no", blocks.alias("n"), F.least(blocks * most, wanted).cast("long").alias("count"), F.floor(F.col("source_no") / STRETCH).alias("stretch")
    )
    rows = rows.filter("count > 0")
    total = rows.agg(F.sum("count")).first()[0] or 1
    size = -(-total // -(-total // shard_blocks))  # of a shard; the last one may be smaller
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    ahead = rows.groupBy("stretch").agg(F.sum("count").alias("slots")).select("stretch", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("stretch").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(ahead, "stretch")
    slot = F.col("ahead") + F.col("inside") + F.col("i")
    place = permuted(slot, F.lit(total).cast("long"), F.lit(seed), F.lit("draws"), rounds=DRAW_ROUNDS)
    drawn = in_parts(rows, "source_no").select(F.floor(place / size).alias("shard"), "source_no", "n")
    return drawn.groupBy("shard", "source_no").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("count"))


def slots(counts: DataFrame, seed: int) -> DataFrame:
    """``shard``, ``slot`` (its place there), ``source_no`` and ``block`` for each block of the mix of ``draws``."""
    own = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select(
        "*",
        F.coalesce(F.sum("count").over(own), F.lit(0)).alias("first"),
        F.coalesce(F.sum("count").over(inside), F.lit(0)).alias("place"),
        F.sum("count").over(Window.partitionBy("shard")).alias("size"),
    )
    rows = in_parts(rows, "shard", "source_no")
    j = F.col("first") + F.col("i")
    rows = rows.withColumn("turn", F.floor(j / F.col("n")))
    key = F.lit(seed), F.col("source_no"), F.col("turn")
    return rows.select(
        "shard",
        permuted(F.col("place") + F.col("i"), F.col("size"), F.lit(seed), F.col("shard"), F.lit("slot")).alias("slot"),
        "source_no",
        permuted(j - F.col("turn") * F.col("n"), F.col("n"), *key).alias("block"),
    )


def packed(sizes: DataFrame, targets: DataFrame, block: int, docs_per_chunk: int = DOCS_PER_CHUNK) -> DataFrame:
    """``sizes`` with ``source_no``, ``source_size``, ``target`` and ``start``, the first word in the source's stream."""
    small = targets.count() <= BROADCAST_SOURCES
    right = (F.broadcast(targets) if small else targets).withColumnRenamed("source", "__source")
    rows = sizes.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    chunks = max(1, sizes.count() // docs_per_chunk)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
        .select("source_no", "chunk", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    )
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.join(starts, ["source_no", "chunk"]).select(*[c for c in rows.columns if c != "chunk"], start.alias("start"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """Which words of which document a block holds: source_no, block, start, first_word, words."""
    end = F.col("start") + F.col("size")
    cut = rows.filter("size > 0").select(
        "source_no", "doc_id", "start", "size", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    return cut.select("source_no", "block", "doc_id", "start", (low - F.col("start")).alias("first_word"), (high - low).alias("words"))


class Mix:
    """The mix of ``docs`` (``doc_id``, ``text``, ``source``), whose tables are made once.

    ``rows``: one row per document. ``slots()``: the blocks of each output shard in order. ``contents()``:
    the same with the documents' words in them. ``taken()``: words taken from every document, and the first output
    shard that holds some of them.

    A NULL text has no words, and a document without words is taken zero times; NULL sources are one source.
    Repeated rows are documents of their own; an empty table gives no rows; other columns are not looked at.
    """

    def __init__(
        self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, seed: int = 17,
    ):
        self.block, self.seed = block_words, seed
        sizes = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
        self.targets = kept(source_targets(sizes, weights, most), "mix-targets")
        self.rows = kept(packed(sizes, self.targets, block_words), "mix-packed")
        self.draws = kept(draws(self.targets, block_words, shard_blocks, most, seed), "mix-draws")

    def slots(self) -> DataFrame:
        return slots(self.draws, self.seed)

    def contents(self) -> DataFrame:
        return pieces(self.rows, self.block).join(self.slots().hint("merge"), ["source_no", "block"])

    def taken(self) -> DataFrame:
        times = self.slots().groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
        parts = pieces(self.rows, self.block).join(times.hint("merge"), ["source_no", "block"])  # not small, whatever the estimate
        # documents with words have a start of their own in their source
        sums = parts.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
        some = self.rows.filter("size > 0").join(sums, ["source_no", "start"], "left")
        none = self.rows.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
        columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard"]
        return some.select(*columns).unionByName(none.select(*columns))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` as the mix takes them: each row so many times, 0 to 3, as the mix takes its words on average.

    The fraction of a time is decided by a hash of ``doc_id``. Documents without words stay as they are: they
    take no room in the mix.
    """
    share, copies = free_name(docs, "__share"), free_name(docs, "__copies")
    shares = Mix(docs, seed=seed).taken().filter("size > 0").groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias(share))
    shares = shares.withColumnRenamed("doc_id", "__doc_id")
    times = F.coalesce(F.floor(F.col(share) + uniform(F.lit(seed), F.col("doc_id"), F.lit("copies"))), F.lit(1)).cast("int")
    joined = docs.join(shares, docs["doc_id"].eqNullSafe(shares["__doc_id"]), "left").withColumn(copies, times).filter(f"{copies} > 0")
    again = joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return reduce(DataFrame.drop, ["__doc_id", share, copies], again)


def op9_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "first_shard")
