import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from shipcause.llm.prefix_trie import prefix_trie, rebuilt, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """Turns of each conversation in order; ties by digest, as documented."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def families(own):
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:h] + turns[h:]
    return out


def trie(whole):
    """Every node by its definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq in members:
        own = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += own
            leaves[seq[:d]] += seq not in children
    return sorted(
        (
            min(m), len(seq), min(members[seq[:-1]]) if seq else -1, len(m), len(children.get(seq, ())), leaves[seq], saved[seq],
            sha256(",".join(map(str, sorted(ends.get(seq, ())))).encode()).hexdigest(),
        )
        for seq, m in members.items()
    )


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*names).collect())


def random_rows(seed):
    """Few different turns, so that conversations share much: copies, one inside another, long ones alone and not."""
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        n = rng.choice([0, 1, 2, 3, 5, 9, 20, 45])
        rows += [(c, t, rng.choice("ab"), rng.choice(["x", "yé"]) if t % 8 else "z") for t in range(n)]
    long = [(t, "u", f"t{t}") for t in range(50)]
    for c, n in [(100, 50), (101, 50), (102, 33), (103, 17), (105, 50)]:
        rows += [(c, *t) for t in long[:n]]
    return rows


@pytest.mark.parametrize(("seed", "stride"), [(1, 1), (2, 16)])
def test_trie_by_definition(spark, seed, stride):
    rows = random_rows(seed)
    lists = turn_lists(spark.createDataFrame(rows, SCHEMA))
    assert found(prefix_trie(lists, stride)) == trie(sequences(rows))


def test_rebuilt_by_definition(spark):
    rows = random_rows(3)
    lists = rebuilt(turn_lists(spark.createDataFrame(rows, SCHEMA)))
    assert found(prefix_trie(lists)) == trie(families(sequences(rows)))


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (2, 0, None, None), (2, 1, "", ""), (3, 5, "a", "b"),
        (4, 5, "ab", ""), (None, 0, "user", "nobody"), (5, 0, "user", "long " * 20000), (6, None, None, None), (2**62, 0, "", ""), (-7, 3, "x", "y"),
        (10, 0, "same number", "a"), (10, 0, "same number", "b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("depth", "key", "chain", "n_convs", "turns", "h", "piece")])
    assert found(prefix_trie(turn_lists(clashing))) == trie(sequences(rows))
    whole = trie(families(sequences(rows)))  # some have lost all turns
    assert found(prefix_trie(rebuilt(turn_lists(clashing)))) == whole
    assert prefix_trie(rebuilt(turn_lists(df.limit(0)))).collect() == []


def test_turnless_conversations(spark):
    lists = spark.createDataFrame([(7, []), (3, [])], "conv_id long, turns array<binary>")
    assert found(prefix_trie(lists)) == [(3, 0, -1, 2, 0, 1, 0, sha256(b"3,7").hexdigest())]


def test_copies_without_end(spark):
    """Half of all conversations are the same one: its list of ids is hashed in pieces."""
    rows = [(c, t, "u", f"{t}" if c % 2 else f"{c} {t}") for c in range(20_000) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie(turn_lists(df)).filter("n_convs > 1").orderBy("depth").collect()
    ids = sha256(",".join(str(c) for c in range(1, 20_000, 2)).encode()).hexdigest()
    assert [(r.depth, r.n_convs, r.n_children, r.saved_tokens) for r in got] == [
        (0, 20_000, 10_001, 19_998), (1, 10_000, 1, 19_998), (2, 10_000, 0, 9_999)
    ]
    assert got[2].ends_sha256 == ids
