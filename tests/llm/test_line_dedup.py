from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shipcause.llm.line_dedup import (
    SEGMENT_BYTES, Pair, drop_repeated_lines, probes, short, suspects, twice_seen, whole,
)



def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def by_hand(rows, least=10):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add((i is None, i or 0))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (i is None, i or 0)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(drop_repeated_lines(odd_docs)) == by_hand(rows)
    assert drop_repeated_lines(no_docs).collect() == []


@pytest.fixture(scope="module")
def lines(spark):
    """A line that most documents hold, lines equal but for case and white space, lines repeated inside, rows without id."""
    rows = [(i, f"The common line of all\nown line number {i}\n\n  shared by {i // 2} and another\t\n") for i in range(400)]
    rows += [(400, "ÀÉ Upper Case Line\nshort"), (401, "  ÀÉ upper case LINE\r\nshort"), (402, "àé upper case line\n\x85 0123456789\n 0123456789 ")]
    rows += [(403, "twice in one text\ntwice in one text"), (403, "the same document goes on\nTWICE in one text"), (None, "only without an id\nnot an id, but a line")]
    rows += [(None, "only without an id\nfound with an id too"), (404, "found with an id too\nfound with an id too"), (405, "日本語の行日本語の行"), (406, "日本語の行日本語の行")]
    rows += [(407, "123456789"), (408, "123456789"), (409, "1234567890"), (410, "1234567890"), (411, "a long line " * 5000), (412, "a long line " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("row", "key", "h", "segment", "words", "first", "gone", "n", "position")])


@pytest.mark.parametrize("filter_bytes", [SEGMENT_BYTES, 1 << 26])
def test_lines_by_hand(lines, filter_bytes):
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert found(drop_repeated_lines(lines, filter_bytes=filter_bytes)) == by_hand(rows)
    assert found(drop_repeated_lines(lines.repartition(7), 3, filter_bytes)) == by_hand(rows, 3)


def test_only_suspects_move(spark):
    """Lines that one document has are not shuffled, but for the few that the filter takes for repeated ones."""
    own = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.sha2(F.col("id").cast("string"), 256), F.lit("line of everyone")).alias("text"))
    rows = suspects(own.repartition(6), 10, 1 << 26)
    assert 20_000 <= rows.count() < 20_400


def test_a_full_filter_suspects_all(spark):
    own = spark.range(60_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows = drop_repeated_lines(own.repartition(3), filter_bytes=SEGMENT_BYTES)
    assert rows.agg(F.sum("n_dropped"), F.sum("n_lines")).first()[:] == (0, 60_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40), max_size=5), st.sampled_from([1, 2, 8]))
def test_a_task_never_misses_a_repeat(documents, segments):
    pair, seen, again = Pair(segments), set(), set()
    for hashes in documents:
        distinct = np.unique(np.array(hashes, np.int64))
        pair.add(distinct)
        again |= seen & set(distinct.tolist())
        seen |= set(distinct.tolist())
    for filters, members in ((pair.once, seen), (pair.twice, again)):
        for h in members:
            place = (h % 2**64 >> 40) & (segments - 1)
            bits = probes(np.array([h], np.int64))[0]
            assert all(filters[place][b >> 3] >> (b & 7) & 1 for b in bits)


def test_tasks_are_merged(spark):
    """A hash that two tasks have seen once each is in the merged filter."""
    rows = spark.createDataFrame([([i, i + 1],) for i in range(0, 5000)], "hashes array<long>").repartition(8)
    seen, segments = twice_seen(rows)
    words = {r.segment: np.array(r.words, "<i8").view(np.uint8) for r in seen.collect()}
    for h in range(1, 5000):
        segment = words[(h >> 40) & (segments - 1)]
        assert all(segment[b >> 3] >> (b & 7) & 1 for b in probes(np.array([h], np.int64))[0])


def test_segments_are_packed_without_loss():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5000, 200_000):
        segment = np.zeros(SEGMENT_BYTES, np.uint8)
        segment[rng.integers(0, SEGMENT_BYTES, n)] = 5
        assert (whole(short(segment)) == segment).all()
