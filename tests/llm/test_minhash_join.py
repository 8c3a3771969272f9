import random
import re
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from shipcause.llm import minhash_join
from shipcause.llm.components import connected_components
from shipcause.llm.minhash_join import COUNTED, POSTED, WordHashes, drop_near_duplicates, minima, near_duplicates, shingle_hashes, threshold

FOLDER = "/root/testdata/sf0.001"
AROUND = [6, 9, 10, 11, 12, 14, 18, 30]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def want(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = [
        (i, j) for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None and x[1]], 2) if 100 * len(a & b) >= percent * len(a | b)
    ]
    root = roots({i for i, _ in sets if i is not None}, links)
    return sorted((str(i), len(s), str(root.get(i)), i is None or root[i] == i) for i, s in sets)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_whole_table_in_both_settings(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs, 3, 85)) == want(rows, 3, 85)
    assert got(near_duplicates(docs)) == want(rows, 5, 80)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(near_duplicates(odd_docs, 3, 85)) == want(rows, 3, 85)
    assert near_duplicates(no_docs).collect() == []
    assert drop_near_duplicates(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_large_group_of_near_copies_and_a_shared_passage(spark, monkeypatch, broadcast):
    """Many texts around one, chains that leave it step by step, and texts that only share a passage."""
    monkeypatch.setattr(minhash_join, "BROADCAST_IDS", broadcast)
    r = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    base = r.choices(words, k=80)
    rows = []
    for _ in range(150):
        copy = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            copy[r.randrange(80)] = r.choice(words)
        rows.append(" ".join(copy))
    chain = list(base)
    for i in range(0, 80, 2):
        chain[i] = f"c{i}"
        rows.append(" ".join(chain))
    passage = " ".join(r.choices(words, k=12))
    rows += [f"{passage} {' '.join(r.choices(words, k=r.choice([0, 1, 5, 40])))}" for _ in range(80)]
    r.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("cid", F.lit("x"))
    assert got(near_duplicates(docs, 3, 85)) == want(list(enumerate(rows)), 3, 85)


def template_pages(n, own, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base, pages = r.choices(words, k=110), []
    for i in range(n):
        page = base[:60] + [f"p{i}x{j}" for j in range(r.choice(own))] + base[60:]
        pages.append(" ".join(page))
        if i % 5 == 0:  # a copy with another last word, linked with the page but not with others
            pages.append(" ".join([*page[:-1], f"q{i}"]))
    r.shuffle(pages)
    return list(enumerate(pages))


@pytest.mark.parametrize(("own", "exact"), [([18], False), (AROUND, False), (AROUND, True)])
def test_pages_of_one_template(spark, monkeypatch, own, exact):
    """Alike but mostly not enough: long lists, all members unconnected; sizes and similarities around the limit."""
    monkeypatch.setattr(minhash_join, "LONG_LIST", 8)
    rows = template_pages(120, own)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs, exact=exact)) == want(rows, 5, 80)


def test_pages_of_one_template_meet_few_others(spark):
    rows = template_pages(200, [18])
    search = minhash_join.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert search.meet_by_shingles(search.components.select("cid")).count() == 40  # of 28,680 pairs


def test_copies_just_below_the_limit_meet_few_others(spark):
    """Many copies of one text with two words changed, and as many with six: the latter are like none of the others."""
    r = random.Random(6)
    base, rows = r.sample([f"w{i}" for i in range(4000)], 150), []
    for i in range(160):
        copy = list(base)
        for at in r.sample(range(0, 150, 4), 2 if i % 2 else 6):
            copy[at] = f"e{i}x{at}"
        rows.append((i, " ".join(copy)))
    search = minhash_join.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    met = search.meet_by_shingles(search.components.select("cid")).collect()
    sets = [shingles(t, 3) for _, t in rows]
    links = {(a, b) for a, b in combinations(range(160), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links <= {(x.a, x.b) for x in met} and len(links) > 3000
    assert len(met) - len(links) < 200  # of 9,560 pairs that are no links


def test_exact(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs, 3, 85, exact=True)) == want(rows, 3, 85)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(near_duplicates(odd_docs, 3, 85, exact=True)) == want(rows, 3, 85)
    assert near_duplicates(no_docs, exact=True).collect() == []


def test_dropped_rows_keep_their_columns(spark):
    rows = [(1, "a b c d e f g h i j", "x"), (2, "a b c d e f g h i j", "y"), (3, "z y x w v", "x"), (4, None, "n"), (None, "a b c d e f g h i j", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(map(str, (x.doc_id for x in out.collect()))) == ["1", "3", "4", "None"]


def test_threshold_and_estimates():
    for k, percent in ((49, 85), (147, 80)):
        below = lambda t: sum(comb(k, i) * (percent / 100) ** i * (1 - percent / 100) ** (k - i) for i in range(t))  # noqa: B023, E731
        assert below(threshold(k, percent)) <= 1e-6 < below(threshold(k, percent) + 1)
    a = shingle_hashes(" ".join(f"w{i}" for i in range(1000)), 1, WordHashes())
    b = shingle_hashes(" ".join(f"w{i}" for i in range(150, 1150)), 1, WordHashes())
    assert abs((minima(a) == minima(b)).mean() - 850 / 1150) < 0.15
    assert len(minima(a)) == COUNTED > POSTED


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)]
    edges += [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7), (9, 8), (8, 9)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
