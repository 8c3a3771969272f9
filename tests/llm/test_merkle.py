from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from shipcause.llm.merkle import (
    butterfly, document_manifest, folded, manifest, proof_text, tree_depth, with_absent,
)



def digest(text):
    return sha256(text.encode()).hexdigest()


def cell(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    return digest("".join(cell(v) for v in (r.doc_id, r.source, r.lang, n, r.text)))


def grown(nodes, fanout):
    """All levels of a tree over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def way(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        run = i // fanout * fanout
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
        i //= fanout
    return out


def by_hand(rows, fanout):
    """(doc_id, leaf, subroot, root, proof text, folded root) of each row, in sections by language."""
    names = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    sections = {n: sorted((r for r in rows if r.lang == n), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r))) for n in names}
    trees = {n: grown([leaf_of(r) for r in sections[n]], fanout) for n in names}
    top = grown([trees[n][-1][0] for n in names], fanout)
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(sections[n]):
            path = way(trees[n], i, fanout) + way(top, k, fanout)
            tampered = r.doc_id is not None and r.n_chars is not None and crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf_of(r, 1) if tampered else leaf_of(r)
            for left, right in path:
                node = digest(left + node + right)
            out.append((r.doc_id, leaf_of(r), trees[n][-1][0], top[-1][0], "".join(a + b for a, b in path), node))
    return sorted(out, key=repr)


def found(rows):
    back = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_text(F.col("path")).alias("proof"), back.alias("folded"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.fixture(scope="module")
def many(spark):
    """Sections of 1 to 37 leaves, repeated rows and NULLs in every column."""
    rows = [(i, f"s{i % 3}", f"l{n}", i, "text " * (i % 4)) for n, size in enumerate((37, 16, 9, 1, 5)) for i in range(size)]
    rows += [(3, "a", None, 3, "x"), (3, "a", None, 3, "x"), (3, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, "")]
    rows += [(2**63 - 1, "é", "日本", 2**63 - 1, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("leaf", "path", "root", "section", "place", "block", "member")])


@pytest.mark.parametrize(("fanout", "leaves"), [(2, 1), (2, 4), (2, 1024), (3, 3), (5, 30)])
def test_trees_by_hand(many, fanout, leaves):
    assert found(document_manifest(many, fanout, leaves)) == by_hand(many.collect(), fanout)


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    assert found(document_manifest(docs, 2, 4)) == by_hand(docs.collect(), 2)
    assert document_manifest(docs.limit(0)).collect() == []


def test_members_all_get_the_root(spark):
    """Every partition, also one without leaves, ends its rounds with the same root and its own siblings."""
    nodes = [digest(str(i)) for i in range(11)]
    frame = spark.createDataFrame([("s", i, n) for i, n in enumerate(nodes)], "section string, member long, node string")
    sizes = spark.createDataFrame([("s", 3)], "section string, rounds int")
    rows = butterfly(with_absent(frame, sizes, 3), 3).orderBy("member").collect()
    levels = grown(nodes, 3)
    assert len(rows) == 27 and {r.node for r in rows} == {levels[-1][0]}
    assert [[tuple(p) for p in r.path] for r in rows[:11]] == [way(levels, i, 3) for i in range(11)]


def test_depth(spark):
    sizes = [1, 2, 3, 4, 5, 8, 9, 81, 82, 3**20, 3**20 + 1]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(tree_depth(F.col("n"), 3).alias("d")).collect()
    assert [r.d for r in rows] == [0, 1, 1, 2, 2, 2, 2, 4, 5, 20, 21]


def test_other_columns_stay(many):
    rows = many.select("doc_id", F.col("lang").alias("part"), F.sha2(F.col("doc_id").cast("string"), 256).alias("leaf"), "source")
    out = manifest(rows.filter("leaf is not null"), "part", ["doc_id"], 2, 8)
    assert out.columns == ["doc_id", "part", "leaf", "source", "subroot", "root", "path"]
    assert out.filter(folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
