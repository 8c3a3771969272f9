"""Dropping repeated lines with two Bloom filters.

1. Every document's distinct line keys are hashed to 64 bits and written, 8 bytes a key.
2. Each task passes its hashes through two filters: a hash not in the once-seen filter is put there, one that is
   there already is put in the twice-seen filter. Filters of tasks are merged segment by segment: what is once-seen
   in two of them is twice-seen in the merged one. A bit can be set too often but never be missing, so every key that
   two documents hold is in the merged twice-seen filter.
3. Lines outside that filter stay and are not moved. Only those inside, the suspects, are shuffled, by SHA-256 of their
   key: an exact grouping tells which keys two documents hold and which document is the first.
4. A document gets the positions of its lines that go.

A filter is cut into segments of 32 KB; a key's bits all lie in one segment, so filters are merged, and looked up by a
join, segment by segment. The filters grow with the number of keys up to ``FILTER_BYTES``. Beyond some 33 million
keys at that size a growing part of single lines become suspects too: more rows are shuffled, and the result
stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import kept, ship_package, table

#: What is stripped from both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10

SEGMENT_BITS = 1 << 18
SEGMENT_BYTES = SEGMENT_BITS // 8
SEGMENT_WORDS = SEGMENT_BITS // 64
BITS_PER_KEY = 16
PROBES = 4
#: The most bytes of a filter (a power of two times a segment). The twice-seen one is broadcast: this is its bound.
FILTER_BYTES = 1 << 26
#: A key that more than this part of all suspects have is met by broadcast; there are less than its inverse.
HOT_KEY = 1 / 1000


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def probes(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash in its segment, ``PROBES`` columns."""
    a = hashes & (SEGMENT_BITS - 1)
    b = (hashes >> 18) & (SEGMENT_BITS - 1) | 1
    return (a[:, None] + b[:, None] * np.arange(PROBES)) & (SEGMENT_BITS - 1)


def in_filter(h: Column, words: Column) -> Column:
    """Whether all bits of hash ``h`` are set in its segment ``words`` (64 bits each); as ``probes``."""
    a, b = h.bitwiseAND(SEGMENT_BITS - 1), F.shiftright(h, 18).bitwiseAND(SEGMENT_BITS - 1).bitwiseOR(F.lit(1).cast("long"))
    found = F.lit(True)
    for i in range(PROBES):
        bit = (a + b * i).bitwiseAND(SEGMENT_BITS - 1)
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        found = found & (F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1)
    return found


def segment_of(h: Column, segments: int) -> Column:
    """The segment of hash ``h``, by bits that ``probes`` does not read."""
    return F.shiftrightunsigned(h, 40).bitwiseAND(segments - 1).cast("int")


class Pair:
    """The once-seen and the twice-seen filter of one task; segments are made when they are needed."""

    def __init__(self, segments: int):
        self.segments = segments
        self.once: dict[int, np.ndarray] = {}
        self.twice: dict[int, np.ndarray] = {}

    def add(self, hashes: np.ndarray) -> None:
        """Each hash once per document that holds its key."""
        distinct, counts = np.unique(hashes, return_counts=True)
        place = (distinct.view(np.uint64) >> np.uint64(40)).astype(np.int64) & (self.segments - 1)
        bits = probes(distinct)
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        for rows in np.split(order, starts[1:]) if len(order) else []:
            seg = int(place[rows[0]])
            once = self.once.setdefault(seg, np.zeros(SEGMENT_BYTES, np.uint8))
            mine = bits[rows]
            known = (once[mine >> 3] >> (mine & 7) & 1).all(axis=1)
            again = mine[known | (counts[rows] > 1)].ravel()
            if len(again):
                set_bits(self.twice.setdefault(seg, np.zeros(SEGMENT_BYTES, np.uint8)), again)
            set_bits(once, mine.ravel())

    def packed(self) -> Iterator[pa.RecordBatch]:
        for seg, once in self.once.items():
            twice = self.twice.get(seg)
            cells = [short(once), short(twice) if twice is not None else b""]
            yield pa.RecordBatch.from_arrays(
                [pa.array([seg], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["segment", "once", "twice"]
            )


def set_bits(segment: np.ndarray, bits: np.ndarray) -> None:
    np.bitwise_or.at(segment, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))


def short(segment: np.ndarray) -> bytes:
    """A segment as its set bits, 4 bytes each, or whole where that is shorter."""
    bits = np.flatnonzero(np.unpackbits(segment, bitorder="little")).astype("<u4")
    return bits.tobytes() if 4 * len(bits) < SEGMENT_BYTES else segment.tobytes()


def whole(cell: bytes) -> np.ndarray:
    if len(cell) == SEGMENT_BYTES:
        return np.frombuffer(cell, np.uint8)
    segment = np.zeros(SEGMENT_BITS, np.uint8)
    segment[np.frombuffer(cell, "<u4")] = 1
    return np.packbits(segment, bitorder="little")


def twice_seen(hashes: DataFrame, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, int]:
    """The merged twice-seen filter of ``hashes`` (an array per document): segment, words; and its number of segments."""
    ship_package(hashes.sparkSession)
    keys = hashes.agg(F.sum(F.size("hashes"))).first()[0] or 0
    wanted = max(1, keys * BITS_PER_KEY // SEGMENT_BITS)
    segments = min(1 << (wanted - 1).bit_length(), max(1, filter_bytes // SEGMENT_BYTES))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(segments)
        for batch in batches:
            pair.add(batch["hashes"].flatten().to_numpy(zero_copy_only=False))
        yield from pair.packed()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = pa.array([twice.view("<i8")], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), words], ["segment", "words"])

        now, once, twice = None, None, None
        for batch in batches:
            for seg, a, b in zip(*(batch[c].to_pylist() for c in ("segment", "once", "twice"))):
                if seg != now:
                    if now is not None:
                        yield out()
                    now, once, twice = seg, np.zeros(SEGMENT_BYTES, np.uint8), np.zeros(SEGMENT_BYTES, np.uint8)
                a = whole(a)
                twice |= (once & a) | whole(b)
                once |= a
        if now is not None:
            yield out()

    parts = hashes.mapInArrow(built, "segment int, once binary, twice binary")
    ordered = parts.repartition("segment").sortWithinPartitions("segment")
    return kept(ordered.mapInArrow(merged, "segment int, words array<bigint>"), "twice-seen"), segments


def identity(docs: DataFrame) -> Column:
    """What tells rows apart: equal rows are dealt with alike."""
    text = F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text), 256))


def suspects(docs: DataFrame, least_chars: int, filter_bytes: int) -> DataFrame:
    """Lines whose key may be in two documents: row, doc_id, position, key (SHA-256)."""
    long_enough = lambda k: F.length(k) >= least_chars
    keys = F.filter(F.transform(lines(F.col("text")), line_key), long_enough)
    hashes = kept(docs.select(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k))).alias("hashes")), "line-hashes")
    seen, segments = twice_seen(hashes, filter_bytes)
    rows = docs.select(identity(docs).alias("row"), "doc_id", F.posexplode(lines(F.col("text"))).alias("position", "line"))
    rows = rows.select("row", "doc_id", "position", line_key(F.col("line")).alias("key")).filter(long_enough(F.col("key")))
    rows = rows.withColumn("h", F.xxhash64("key")).withColumn("segment", segment_of(F.col("h"), segments))
    met = rows.join(F.broadcast(seen), "segment").filter(in_filter(F.col("h"), F.col("words")))
    return kept(met.select("row", "doc_id", "position", F.unhex(F.sha2("key", 256)).alias("key")), "suspects")


def repeated(rows: DataFrame) -> DataFrame:
    """Keys of ``suspects`` that two documents hold: key, first (the smallest doc_id), n (lines)."""
    found = rows.groupBy("key").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("doc_id").alias("with_id"), F.count(F.lit(1)).alias("n")
    )
    # rows without id are one document, after all others
    return found.filter((F.col("first") < F.col("last")) | ((F.col("with_id") > 0) & (F.col("with_id") < F.col("n")))).select("key", "first", "n")


def dropped(rows: DataFrame) -> DataFrame:
    """Positions of the lines that go, per row: row, gone. Keys of very many lines, at most 1,000, are broadcast."""
    again, total = kept(repeated(rows), "repeated-keys"), rows.count()
    hot = again.filter(F.col("n") > HOT_KEY * total).select(F.col("key").alias("hot_key"), F.col("first").alias("hot_first"))
    cold = again.filter(F.col("n") <= HOT_KEY * total).select(F.col("key").alias("cold_key"), F.col("first").alias("cold_first"))
    met = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    common = met.filter("hot_key is not null").select("row", "doc_id", "position", F.col("hot_first").alias("first"))
    rare = met.filter("hot_key is null").join(cold, F.col("key") == F.col("cold_key"))
    rare = rare.select("row", "doc_id", "position", F.col("cold_first").alias("first"))
    lost = common.unionByName(rare).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy("row").agg(F.collect_set("position").alias("gone"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) without the lines that an earlier document holds.

    Texts are split at line feeds. A line's key is the line stripped of ASCII white space at both ends, A-Z in lower
    case. Lines whose key has at least ``least_chars`` code points and is found in two documents stay in the one with the
    smallest doc_id, all of them there, and go elsewhere. Columns: doc_id, text (lines that stay, joined by line feeds),
    n_lines (before), n_dropped.

    A NULL or empty text is one empty line. Rows that share a doc_id are one document; rows without doc_id are
    one document too, which comes after all others. Repeated rows stay; other columns are not looked at; an empty
    table gives no rows.
    """
    gone = dropped(suspects(docs, least_chars, filter_bytes))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), identity(docs).alias("row"))
    rows = rows.join(gone.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, less = [], [], []
            for text, positions in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
                parts = text.split(b"\n")
                before.append(len(parts))
                less.append(len(positions or ()))
                if positions:
                    away = set(positions)
                    text = b"\n".join(p for i, p in enumerate(parts) if i not in away)
                texts.append(text)
            columns = [batch["doc_id"], pa.array(texts, pa.binary()), pa.array(before, pa.int64()), pa.array(less, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"doc_id {id_type}, text binary, n_lines long, n_dropped long")
    return out.withColumn("text", F.col("text").cast("string"))


def op13_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = f"""
with parts as (
  select doc_id, row_number() over () rid, string_split(coalesce(text, ''), chr(10)) parts from documents),
rows as (select doc_id, rid, unnest(parts) line, unnest(range(len(parts))) i from parts),
keys as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') k from rows),
firsts as (select k, min(doc_id) first from keys where length(k) >= {LEAST_CHARS} group by k having count(distinct doc_id) > 1),
judged as (select keys.*, firsts.first is not null and doc_id <> firsts.first gone from keys left join firsts on firsts.k = keys.k)
select doc_id, count(*) n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) n_dropped,
  sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by i), '')) kept_sha256
from judged group by doc_id, rid
"""
