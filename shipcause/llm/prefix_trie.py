"""Prefix trie of conversations by truncation peeling.

A conversation is a row of turn digests, each over all turns so far, so the last one names the whole sequence.
Peeling starts at the greatest depth and goes up: the conversations that end at a depth join the nodes that survive
from below, every row is grouped by its whole sequence, the group is a node, and its last turn is stripped for the
next depth. Children are counted and their measures added up in the same grouping that finds the node, so the trie
is discovered and aggregated in one pass from the leaves to the root, a shuffle per depth, with map-side
combining: a prefix that most conversations share costs one row per task.

Equal conversations are merged before. Where all that goes through a prefix is one sequence, its tail is a chain
whose nodes follow from that sequence alone; they are written at once, and peeling starts above them. Long
conversations without company therefore cost no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import kept, ship_package, table
from shipcause.llm.merkle import CRC32_SQL
from shipcause.llm.numbering import numbered
from shipcause.sources.store import new_folder, write_table

#: A packed turn: SHA-256 of the sequence up to it, and the UTF-8 bytes of its text as a big-endian number.
DIGEST, SIZE = 32, 8
STEP = DIGEST + SIZE
#: Depths at which conversations are looked at for being alone.
STRIDE = 16
#: Ids of conversations that are hashed together before a node's list of them is.
IDS_PER_CHUNK = 4096
#: A parent with more than this part of all nodes as children is met by broadcast; there are less than its inverse.
HOT_PARENT = 1 / 1000
#: The most turns taken over from another conversation.
SHARED_TURNS = 8


def packed_turn(role: Column, text: Column) -> Column:
    """Digest of a turn and the size of its text, as binary; the role's length keeps the two apart."""
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.sha2(content, 256), F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * SIZE, "0")))


def turn_lists(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, the packed turns of a conversation in order.

    ``turns``: conv_id, turn, role, text. A NULL turn comes first, turns of equal number go by their digest, NULL
    roles and texts are empty; rows without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", packed_turn(role, text).alias("packed"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "packed"))).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: t["packed"]).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 5) -> DataFrame:
    """``lists`` where each conversation begins with the turns of the first of its ``family`` (by id).

    The first h = crc32(id) % 9 turns are those of conversation id - id % family, all if it has fewer, none if there is
    no such conversation; the conversation's own turns after its first h follow.
    """
    heads = lists.select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, SHARED_TURNS).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_TURNS + 1)).cast("int")
    rows = lists.select("conv_id", "turns", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first_id"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(heads, "first_id", "left").select("conv_id", F.concat(taken, own).alias("turns"))


def chains(lists: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` and ``chain``: each turn's digest replaced by one over all turns up to it, all in one binary."""
    ship_package(lists.sparkSession)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths, out = [], []
            for turns in batch["turns"].to_pylist():
                running, chain = sha256(), bytearray()
                for turn in turns:
                    running.update(turn[:DIGEST])
                    chain += running.digest() + turn[DIGEST:]
                depths.append(len(turns))
                out.append(bytes(chain))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.array(depths, pa.int64()), pa.array(out, pa.binary())], ["conv_id", "depth", "chain"]
            )

    plain = lists.select(F.col("conv_id").cast("long").alias("conv_id"), "turns")
    return plain.mapInArrow(chained, "conv_id long, depth long, chain binary")


def key_at(depth: Column | int) -> Column:
    """The digest that names the first ``depth`` turns of ``chain``; empty for none."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    at = F.substring(F.col("chain"), (STEP * (depth - 1) + 1).cast("int"), F.lit(DIGEST))
    return F.when(depth > 0, at).otherwise(F.lit(b""))


def bytes_at(depth: Column) -> Column:
    """UTF-8 bytes of the text of turn ``depth`` of ``chain``; 0 for none."""
    at = F.substring(F.col("chain"), (STEP * depth - SIZE + 1).cast("int"), F.lit(SIZE))
    return F.when(depth > 0, F.conv(F.hex(at), 16, 10).cast("long")).otherwise(F.lit(0))


NODE = ["key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def chain_nodes(ends: DataFrame) -> DataFrame:
    """The nodes from ``alone`` to ``depth`` of sequences that nothing else goes through or ends in."""
    rows = ends.filter("alone is not null")
    saved = lambda d: (F.col("n_convs") - 1) * bytes_at(d)
    # sums from the end: one entry per depth, last first
    down = F.transform(F.reverse(F.sequence("alone", "depth")), lambda d: F.struct(d.alias("d"), saved(d).alias("own")))
    sums = F.aggregate(
        down, F.array().cast("array<struct<d:bigint,sum:bigint>>"),
        lambda done, x: F.array_append(done, F.struct(x["d"].alias("d"), (F.coalesce(F.get(done, F.size(done) - 1)["sum"], F.lit(0)) + x["own"]).alias("sum"))),
    )
    rows = rows.withColumn("flat", F.col("n_convs") == 1)
    nothing = F.transform(F.sequence("alone", "depth"), lambda d: F.struct(d.alias("d"), F.lit(0).cast("long").alias("sum")))
    rows = rows.withColumn("node", F.explode(F.when(F.col("flat"), nothing).otherwise(sums)))
    rows = rows.select("chain", "conv_id", "n_convs", F.col("depth").alias("end"), F.col("node.d").alias("depth"), F.col("node.sum").alias("saved_tokens"))
    return rows.select(
        key_at(F.col("depth")).alias("key"), key_at(F.col("depth") - 1).alias("parent_key"), "depth", "conv_id", "n_convs",
        (F.col("depth") < F.col("end")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens",
    )


def merged_ends(sequences: DataFrame, stride: int) -> DataFrame:
    """One row per distinct sequence: key, chain, depth, conv_id, n_convs, alone.

    ``alone`` is the smallest multiple of ``stride`` such that no other sequence shares so many turns or ends on the
    way there; NULL where there is none.
    """
    ends = sequences.groupBy(key_at(F.col("depth")).alias("key"), "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chain").alias("chain")
    )
    ends = kept(ends, "trie-ends")
    stops = F.sequence(F.lit(stride).cast("long"), F.col("depth"), F.lit(stride).cast("long"))
    seen = ends.filter(F.col("depth") >= stride).select("key", "chain", F.explode(stops).alias("stop"))
    lone = seen.groupBy(key_at(F.col("stop")).alias("at"), "stop").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"))
    lone = lone.filter("n = 1").groupBy("key").agg(F.min("stop").alias("alone"))
    return kept(ends.join(lone, "key", "left"), "trie-sequences")


def entering(ends: DataFrame, chain: DataFrame) -> DataFrame:
    """What joins the peeling: whole sequences at their end, and the upper end of each chain one depth above it."""
    open_ = ends.filter("alone is null").select(
        "depth", "key", "chain", "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    tops = ends.filter("alone is not null").select(F.col("alone").alias("depth"), "chain", "key", "conv_id", "n_convs")
    sums = chain.select(F.col("key").alias("top"), F.col("saved_tokens").alias("sum"))
    tops = tops.join(sums, key_at(F.col("depth")) == F.col("top"))
    tops = tops.select(
        F.col("depth") - 1, key_at(F.col("depth") - 1), F.substring(F.col("chain"), F.lit(1), (STEP * (F.col("depth") - 1)).cast("int")),
        "conv_id", "n_convs", F.lit(1).cast("long"), F.lit(1).cast("long"), "sum",
    )
    return open_.union(tops)


def peeled(rows: DataFrame, top: int) -> DataFrame:
    """The nodes above and at ``rows`` (see ``entering``), depth by depth from ``top``, the greatest, to the root."""
    spark = rows.sparkSession
    folder = new_folder(spark, "trie")
    rows = write_table(rows, f"{folder}/entering", partition_by="depth")
    carried = ["key", "chain", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    below = None
    for depth in range(top, -1, -1):
        at = rows.filter(F.col("depth") == depth).select(*carried)
        if below is not None:
            survivors = below.select(
                key_at(depth).alias("key"), F.substring(F.col("chain"), F.lit(1), F.lit(STEP * depth)).alias("chain"), "conv_id", "n_convs",
                F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
            )
            at = at.unionByName(survivors)
        nodes = at.groupBy("key").agg(
            F.first("chain").alias("chain"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
        own = (F.col("n_convs") - 1) * bytes_at(F.lit(depth))
        nodes = nodes.select(
            "key", "chain", (key_at(depth - 1) if depth else F.lit(None).cast("binary")).alias("parent_key"), "conv_id", "n_convs", "n_children",
            F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + own).alias("saved_tokens"),
        )
        below = write_table(nodes, f"{folder}/nodes/depth={depth}")
    return spark.read.parquet(f"{folder}/nodes").withColumn("depth", F.col("depth").cast("long")).select(*NODE)


def end_digests(sequences: DataFrame) -> DataFrame:
    """``key`` of each whole sequence and ``ends_sha256``, over the ids of all conversations that it is.

    Ids are numbered per sequence and joined in pieces of bounded length; the pieces stream through one hash in
    order, the one thing here that is sequential by nature, without being gathered.
    """
    rows = sequences.select(key_at(F.col("depth")).alias("key"), "conv_id")
    pieces = numbered(rows, "key", ["conv_id"], "i").groupBy("key", F.floor(F.col("i") / IDS_PER_CHUNK).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        keys, digests = [], []
        for batch in batches:
            for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if key == now:
                    running.update(b"," + ids.encode())
                    continue
                if running is not None:
                    keys.append(now)
                    digests.append(running.hexdigest())
                now, running = key, sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
            keys, digests = [], []
        if running is not None:
            last = [pa.array([now], pa.binary()), pa.array([running.hexdigest()], pa.string())]
            yield pa.RecordBatch.from_arrays(last, ["key", "ends_sha256"])

    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids")
    return ordered.mapInArrow(hashed, "key binary, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``. Parents of very many nodes, at most 1,000, are broadcast."""
    total = nodes.count()
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.filter(F.col("n_children") > HOT_PARENT * total)
    cold = parents.filter(F.col("n_children") <= HOT_PARENT * total).select("of", F.col("parent_conv_id").alias("cold_id"))
    hot = hot.select(F.col("of").alias("hot_of"), F.col("parent_conv_id").alias("hot_id"))
    rows = nodes.join(F.broadcast(hot), F.col("parent_key") == F.col("hot_of"), "left").drop("hot_of")
    # children of hot parents go by their own key, and so are spread out
    rows = rows.withColumn("asks", F.when(F.col("hot_id").isNull() & F.col("parent_key").isNotNull(), F.col("parent_key")).otherwise(F.col("key")))
    rows = rows.join(cold, rows["asks"] == cold["of"], "left")
    found = F.when(F.col("parent_key").isNotNull(), F.coalesce("hot_id", "cold_id"))
    return rows.select(*nodes.columns, found.alias("parent_conv_id"))


def prefix_trie(lists: DataFrame, stride: int = STRIDE) -> DataFrame:
    """All nodes of the trie over ``lists`` (``conv_id``, ``turns`` as ``turn_lists`` packs them).

    Columns: conv_id (smallest member), depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves,
    saved_tokens (summed over the subtree: bytes of a node's last text, once for every member but one),
    ends_sha256 (over the ascending ids of the conversations that end there, comma-joined), key (digest of the
    sequence). Conversations without turns are members of the root. No conversations give no rows, not even a root.
    Ids are distinct; a conversation's digests (40 bytes a turn) fit in a row.
    """
    sequences = kept(chains(lists), "trie-chains")
    ends = merged_ends(sequences, stride)
    chain = kept(chain_nodes(ends), "trie-tails")
    top = ends.agg(F.max(F.coalesce(F.col("alone") - 1, "depth"))).first()[0]
    nodes = chain if top is None else kept(peeled(entering(ends, chain), top).unionByName(chain), "trie-nodes")
    rows = with_parents(nodes).join(end_digests(sequences), "key", "left")
    ends_sha = F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest()))
    return rows.select("key", "conv_id", "depth", "parent_conv_id", *NODE[4:], ends_sha.alias("ends_sha256"))


def op11_truncation_peeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_lists(table(spark, sf_dir, "conversations")))).drop("key")


OP11_SQL = f"""
with own as (
  select conv_id, list(row(coalesce(role, ''), coalesce(text, '')) order by turn nulls first) turns
  from conversations where conv_id is not null group by conv_id),
drawn as (select *, {CRC32_SQL.format("conv_id")} % 9 h from own),
whole as (
  select o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) turns
  from drawn o left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
prefixes as (select conv_id, d depth, turns[1:d] seq, len(turns) = d ended from (select *, unnest(range(len(turns) + 1)) d from whole)),
nodes as (
  select depth, seq, min(conv_id) conv_id, count(*) n_convs,
    sha256(coalesce(string_agg(case when ended then conv_id::varchar end, ',' order by conv_id), '')) ends_sha256,
    (count(*) - 1) * case when depth > 0 then strlen(any_value(seq)[depth][2]) else 0 end own
  from prefixes group by depth, seq),
children as (select depth - 1 depth, seq[1:depth - 1] seq, count(*) n from nodes where depth > 0 group by all),
counted as (select nodes.*, coalesce(n, 0) n_children from nodes left join children using (depth, seq)),
above as (select a.depth, a.seq[1:a.depth] seq, own, n_children from
  (select seq, own, n_children, unnest(range(depth + 1)) depth from counted) a),
sums as (select depth, seq, sum(own) saved_tokens, sum(case when n_children = 0 then 1 else 0 end) n_leaves from above group by depth, seq)
select c.conv_id, c.depth, p.conv_id parent_conv_id, c.n_convs, c.n_children, cast(n_leaves as bigint) n_leaves,
  cast(saved_tokens as bigint) saved_tokens, c.ends_sha256
from counted c join sums using (depth, seq) left join nodes p on p.depth = c.depth - 1 and p.seq = c.seq[1:c.depth - 1]
"""
