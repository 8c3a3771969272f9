"""Merkle manifest of a table: a digest per row, one root for all, and a proof per row.

1. A row's leaf is the digest of its columns. Leaves are numbered within their section (here: language) and cut
   into partitions of ``fanout ** levels`` leaves, aligned to the tree, so each partition is a whole subtree.
2. Every partition hashes its subtree on its own.
3. Butterfly exchange: in round r, the ``fanout`` partitions whose numbers differ in digit r alone swap the roots
   they have so far. All of them hash the same parent, so each ends the round with the ancestor above it and with
   the siblings beside its own way up. After the last round every partition holds the section's root and its own
   upper proof; nothing has to be sent down again. Missing partitions take part with no root, which keeps all
   groups whole, and learn it from the others.
4. The sections' roots go through the same rounds among themselves.
5. A leaf's proof is its way through its own partition followed by that of the partition.

A round is one small shuffle of a row per partition; groups hold ``fanout`` rows. Rows of the table are moved as
narrow digests only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import kept, ship_package, table
from shipcause.llm.numbering import numbered

FANOUT = 2
#: At most so many leaves are hashed together in one partition of the tree.
PARTITION_LEAVES = 1024
#: Rounds between two writes of the (small) table of partitions, which cut its lineage.
ROUNDS_PER_WRITE = 6
#: Up to so many sections their table (some 3 KB a row) is broadcast; beyond, it is joined by shuffling.
BROADCAST_SECTIONS = 1000

PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text in UTF-8."""
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*[encoded(v) for v in values]))


def tree_depth(leaves: Column, fanout: int) -> Column:
    """Levels above ``leaves`` leaves: the smallest d with fanout ** d >= leaves."""
    powers = F.array(*[F.lit(fanout**d) for d in range(63) if fanout**d < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < leaves))


def parents(nodes: Sequence[str], fanout: int) -> list[str]:
    """The level above ``nodes`` (hex digests): the digest of each run of ``fanout``, the last one maybe shorter."""
    return [sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def levels_above(leaves: Sequence[str], levels: int, fanout: int) -> list[list[str]]:
    """``leaves`` and the ``levels`` levels above them."""
    tree = [list(leaves)]
    for _ in range(levels):
        tree.append(parents(tree[-1], fanout))
    return tree


def siblings(tree: Sequence[Sequence[str]], at: int, fanout: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of leaf ``at`` and of its ancestors in their runs, below the top of ``tree``."""
    for nodes in tree[:-1]:
        run = at - at % fanout
        yield "".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])
        at //= fanout


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on its ``path`` give."""
    return F.aggregate(path, leaf, lambda node, beside: digest(F.concat(beside["left"], node, beside["right"])))


def proof_text(path: Column) -> Column:
    """All siblings on a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), "")


def butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """All rounds over ``state``: ``section``, ``member`` (0 to fanout ** rounds - 1), ``node`` (NULL: none), ``rounds``.

    Returns section, member, node (the section's root) and path (of the member's own node to that root).
    """
    state = kept(state.withColumn("path", F.array().cast(PATH)), "butterfly")
    last = state.agg(F.max("rounds")).first()[0] or 0
    for r in range(last):
        taking_part = F.col("rounds") > r
        digit = F.floor(F.col("member") / fanout**r) % fanout
        first = F.when(taking_part, F.col("member") - digit * fanout**r).otherwise(F.col("member"))
        groups = state.groupBy("section", "rounds", first.alias("first")).agg(
            F.sort_array(F.collect_list(F.struct("member", "node", "path"))).alias("members")  # fanout of them
        )
        nodes = lambda keep: F.array_join(
            F.transform(F.filter("members", keep), lambda m: F.coalesce(m["node"], F.lit(""))), ""
        )
        whole = nodes(lambda m: F.lit(True))
        swapped = groups.select("section", "rounds", "members", F.when(whole != "", digest(whole)).alias("parent"), F.explode("members").alias("me"))
        left, right = nodes(lambda m: m["member"] < F.col("me.member")), nodes(lambda m: m["member"] > F.col("me.member"))
        longer = F.array_append("me.path", F.struct(left.alias("left"), right.alias("right")))
        state = swapped.select(
            "section", "rounds", F.col("me.member").alias("member"),
            F.when(taking_part, F.col("parent")).otherwise(F.col("me.node")).alias("node"),
            F.when(taking_part, longer).otherwise(F.col("me.path")).alias("path"),
        )
        if r % ROUNDS_PER_WRITE == ROUNDS_PER_WRITE - 1:
            state = kept(state, "butterfly")
    return kept(state.select("section", "member", "node", "path"), "butterfly")


def with_absent(nodes: DataFrame, sizes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (section, member, node) filled up with nodeless members to fanout ** rounds by ``sizes`` (section, rounds)."""
    last = F.pow(F.lit(float(fanout)), F.col("rounds")).cast("long") - 1
    members = sizes.select("section", "rounds", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("member"))
    return members.join(nodes, ["section", "member"], "left").select("section", "member", "node", "rounds")


def manifest(
    leaves: DataFrame, section: str, order: Sequence[str], fanout: int = FANOUT, partition_leaves: int = PARTITION_LEAVES
) -> DataFrame:
    """``leaves`` with ``subroot`` (of their section), ``root`` (of all sections) and ``path``.

    ``leaves`` has the digest of each row in ``leaf``. Within a section leaves ascend by ``order`` (NULL first,
    equal ones by their digest); while more than one node remains, every ``fanout`` consecutive ones, the last run
    maybe fewer, become their digest. A lone leaf is the subroot itself. Sections, ordered by name (NULL first,
    bytewise), form the tree above in the same way. ``path`` goes from leaf to root, one entry (left, right) per
    level: the digests beside the node in its run, concatenated. ``folded`` and ``proof_text`` read it.

    Repeated rows are leaves of their own; no rows give no rows. ``leaves`` may hold other columns, which stay,
    unless they are named like the ones that are added or begin with two underscores.
    """
    levels = max(d for d in range(63) if fanout**d <= max(partition_leaves, fanout))
    width = fanout**levels
    added = {"section", "block", "place", "subroot", "root", "path"}
    names = [c for c in leaves.columns if c.lower() not in added]
    name = F.coalesce(F.concat(F.lit("="), F.col(section).cast("string")), F.lit(""))  # NULL before any text
    rows = kept(leaves.select(*names, name.alias("section"), F.monotonically_increasing_id().alias("__tie")), "leaves")
    rows = numbered(rows, "section", [*order, "leaf", "__tie"], "place").withColumn("block", F.floor(F.col("place") / width))
    rows = kept(rows.drop("__tie"), "merkle-leaves")

    depth = tree_depth(F.col("n"), fanout)
    sizes = rows.groupBy("section").agg(F.count(F.lit(1)).alias("n")).select(
        "section", "n", F.least(depth, F.lit(levels)).alias("local"), F.greatest(depth - levels, F.lit(0)).alias("rounds")
    )
    sizes = kept(sizes, "sections")
    few = sizes.count() <= BROADCAST_SECTIONS
    small = F.broadcast if few else (lambda df: df.hint("merge"))

    ship_package(leaves.sparkSession)
    local = rows.select("section", "block", "place", "leaf").join(small(sizes.select("section", "local")), "section")

    def subtree(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        tree = levels_above(group["leaf"].to_pylist(), group["local"][0].as_py(), fanout)
        return pa.table({"section": group["section"][:1], "member": group["block"][:1], "node": [tree[-1][0]]})

    subtrees = local.groupBy("section", "block").applyInArrow(subtree, "section string, member long, node string")
    upper = butterfly(with_absent(subtrees, sizes, fanout), fanout)

    tops = numbered(upper.filter("member = 0").select(F.lit("").alias("all"), "section", "node"), "all", ["section"], "member")
    tops = kept(tops, "subroots")
    whole = tops.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("section"), depth.alias("rounds"))
    above = butterfly(with_absent(tops.select(F.col("all").alias("section"), "member", "node"), whole, fanout), fanout)
    above = above.select("member", F.col("node").alias("root"), F.col("path").alias("above"))
    above = tops.select("section", "member").join(above.hint("merge"), "member").drop("member")

    real = upper.join(small(sizes), "section").filter(F.col("member") * width < F.col("n")).join(small(above), "section")
    ways = real.select(
        "section", F.col("member").alias("block"), "local", F.col("node").alias("subroot"), "root",
        F.transform(F.concat("path", "above"), lambda p: p["left"]).alias("lefts"),
        F.transform(F.concat("path", "above"), lambda p: p["right"]).alias("rights"),
    )
    out = rows.select(*names, *[F.lit(None).cast(t).alias(c) for c, t in [("subroot", "string"), ("root", "string"), ("path", PATH)]]).schema

    def proofs(leaves: pa.Table, way: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("place")
        tree = levels_above(leaves["leaf"].to_pylist(), way["local"][0].as_py(), fanout)
        lefts, rights = way["lefts"][0].as_py(), way["rights"][0].as_py()
        n, offsets, left, right = leaves.num_rows, [0], [], []
        for i in range(n):
            for a, b in siblings(tree, i, fanout):
                left.append(a)
                right.append(b)
            left += lefts
            right += rights
            offsets.append(len(left))
        sides = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        columns = {c: leaves[c] for c in names}
        columns |= {c: pa.repeat(way[c][0], n) for c in ("subroot", "root")}
        return pa.table(columns | {"path": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sides)})

    return rows.groupBy("section", "block").cogroup(ways.groupBy("section", "block")).applyInArrow(proofs, out)


#: The columns of documents that make a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame, fanout: int = FANOUT, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """Leaf, subroot, root and path of every row of ``docs``, by language and ``doc_id``, and a second leaf.

    Columns: doc_id, leaf, tampered_leaf (that of the row with 1 added to ``n_chars`` where 7 divides the crc32 of
    the doc_id, else NULL; NULL ids and NULL n_chars are left alone), subroot, root, path. NULL cells are part of a leaf as
    ``-``; rows of equal doc_id go by their leaves; an empty table gives no rows; other columns are not looked at.
    """
    plain = [F.col(c) for c in LEAF_COLUMNS]
    raised = [(F.col(c).cast("decimal(38,0)") + 1) if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    chosen = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    rows = docs.select(
        "doc_id", "lang", leaf_digest(*plain).alias("leaf"), F.when(chosen, leaf_digest(*raised)).alias("tampered_leaf")
    )
    return manifest(rows, "lang", ["doc_id"], fanout, partition_leaves).drop("lang")


def op12_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_manifest(table(spark, sf_dir, "documents"))
    back = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB: crc32 of the decimal text of an integer.
CRC32_SQL = """xor(list_reduce([cast(4294967295 as bigint)] || list_transform(string_split(cast({0} as varchar), ''), lambda c: cast(ascii(c) as bigint)),
    lambda crc, b: list_reduce([xor(crc, b)] || [cast(0 as bigint), 0, 0, 0, 0, 0, 0, 0],
        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

OP12_SQL = f"""
with recursive cells as (
  select doc_id, lang,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') front,
    n_chars::varchar plain, case when {CRC32_SQL.format("doc_id")} % 7 = 0 then (n_chars + 1)::varchar end raised,
    coalesce(strlen(text) || ':' || text, '-') back from documents),
leaves as (
  select doc_id, coalesce('=' || lang, '') section, sha256(front || coalesce(strlen(plain) || ':' || plain, '-') || back) leaf,
    sha256(front || strlen(raised) || ':' || raised || back) tampered from cells),
placed as (
  select *, row_number() over () rid, row_number() over (partition by section order by doc_id nulls first, leaf) - 1 i from leaves),
below(section, lvl, i, node) as (
  select section, 0, i, leaf from placed
  union all
  select section, lvl + 1, i // 2, sha256(string_agg(node, '' order by i))
  from (select *, count(*) over (partition by section) n from below) where n > 1 group by section, lvl, i // 2),
heights as (select section, max(lvl) height from below group by section),
subroots as (
  select section, height, node, row_number() over (order by section) - 1 i
  from below join heights using (section) where lvl = height),
above(lvl, i, node) as (
  select 0, i, node from subroots
  union all
  select lvl + 1, i // 2, sha256(string_agg(node, '' order by i))
  from (select *, count(*) over () n from above) where n > 1 group by lvl, i // 2),
root as (select lvl height, node from above order by lvl desc limit 1),
steps as (
  select rid, k step, (p.i >> k) & 1 as on_right, node
  from (select rid, section, i, unnest(range(height)) k from placed join heights using (section)) p
    left join below b on b.section = p.section and b.lvl = k and b.i = xor(p.i >> k, 1)
  union all
  select rid, p.height + k, (p.i >> k) & 1, node
  from (select rid, s.height, s.i, unnest(range(root.height)) k from placed join subroots s using (section), root) p
    left join above a on a.lvl = k and a.i = xor(p.i >> k, 1)),
fold(rid, step, node) as (
  select rid, 0, coalesce(tampered, leaf) from placed
  union all
  select f.rid, f.step + 1, sha256(case when on_right = 1 then s.node || f.node else f.node || coalesce(s.node, '') end)
  from fold f join steps s on s.rid = f.rid and s.step = f.step),
proofs as (select rid, string_agg(node, '' order by step) siblings from steps group by rid),
ends as (select rid, max_by(node, step) folded_root from fold group by rid)
select doc_id, leaf, s.node subroot, root.node root, sha256(coalesce(siblings, '')) proof_sha256, folded_root,
  folded_root = root.node verified
from placed p join subroots s using (section) join ends using (rid) left join proofs using (rid), root
"""
