"""Near-duplicates by an inverted join over MinHash coordinates, confirmed on whole shingle sets.

1. Texts with equal shingle sets are one class, the smallest doc_id; only classes are compared.
2. A class is posted under its (coordinate, value) pairs. Two sets of similarity s agree in each coordinate with
   probability s, so two that are similar enough agree in fewer than T of the K coordinates only once in a
   million times. Hence they share one of each other's K - T + 1 rarest pairs: only these are posted, values
   that occur once not at all, and passages that very many documents share are skipped without loss.
3. Pairs of classes that meet in a posting list count their collisions over all coordinates and some more that
   are not posted. Those that reach the threshold are compared on their whole sets.
4. What is asked for are the components of the graph of links. So a long list is not multiplied out: first all
   its members are compared with one of them, in the next rounds members that are not connected yet with others
   of them, and only at last the rest with every member of the list outside their own component.
5. Where that rest is long (pages of one template, alike but not enough), its members meet in lists of rare
   shingles instead. If the smaller of two similar sets has n shingles, they have 2s/(1+s) of n in common, and
   the larger one has s of its own: in one order of all shingles, rare ones first, the first common one stands
   among the first (1-s)/(1+s) of the smaller set and the first 1-s of the larger one. Two pages that fall short
   of s by their own words have more of these than the smaller one's part, so they never meet.
   Its places in both sets bound what is left for them to share, and pairs without enough left do not meet.

A link is missed only if its collisions fall below the threshold (odds MISS at exactly the limit, far less
above it); none is dropped for the length of a list or the number of partners. On request step 5 takes all
classes and no threshold, which misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import kept, ship_package, table
from shipcause.llm.components import connected_components

#: Posted coordinates; coordinates that are counted, seven to a number, one byte each.
POSTED, COUNTED, PER_WORD = 49, 147, 7
#: Coordinates that are counted besides in the last round, only for the classes left by then.
FINE = 588
WORDS = [f"s{i}" for i in range(COUNTED // PER_WORD)]
FINE_WORDS = [f"f{i}" for i in range(FINE // PER_WORD)]
MISS = 1e-6
HUB_ROUNDS = 3
#: Up to so many members outside a list's largest component meet the whole list; more meet by rare shingles.
LONG_LIST = 64
#: Buckets in which shingles are counted to tell rare from common ones; a power of two, eight bytes each.
BUCKETS = 1 << 18
#: Id lists up to this length (8 bytes each) are broadcast; longer ones are joined by shuffling.
BROADCAST_IDS = 1_000_000
REMEMBERED_WORDS = 200_000
ROWS_PER_BATCH = 500

_random = np.random.default_rng(20240229)
MULTIPLY = _random.integers(1, 2**63, COUNTED + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 2**63, COUNTED + FINE, dtype=np.uint64)
SHINGLE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, those seen lately remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str, width: int, words: WordHashes) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted 64-bit hashes; a shorter text is one shingle."""
    found = text.encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII separators
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(each))
    h = np.full(len(each) - width + 1, width, np.uint64)
    for k in range(width):
        h += each[k : len(each) - width + 1 + k] * SHINGLE[k]
        h ^= h >> np.uint64(29)
        h *= SHINGLE[-1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minima(hashes: np.ndarray, which: slice = slice(COUNTED)) -> np.ndarray:
    """The smallest value of every coordinate's own hash function, as unsigned 32-bit numbers."""
    multiply, add_ = MULTIPLY[which], ADD[which]
    low = np.full(len(add_), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[at : at + 4096, None] * multiply + add_).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def packed(low: np.ndarray) -> list[int]:
    """The last byte of each minimum, seven to a number."""
    place = np.uint64(1) << (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(8))
    return ((low & np.uint32(255)).astype(np.uint64).reshape(-1, PER_WORD) * place).sum(axis=1).astype(np.int64).tolist()


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` (equal for equal sets), ``posted`` values, and the counted bytes."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "known", "n_shingles", "key", "posted", *WORDS]

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BATCH):
                rows = []
                for doc_id, known, text in batch.iloc[at : at + ROWS_PER_BATCH].itertuples(index=False):
                    hashes = shingle_hashes(text, width, words)
                    low = minima(hashes)
                    rows.append((doc_id, known, len(hashes), xxh3_128_digest(hashes.tobytes()), low[:POSTED].astype(np.int64), *packed(low)))
                yield pd.DataFrame(rows, columns=names)

    schema = "doc_id bigint, known boolean, n_shingles bigint, key binary, posted array<bigint>, " + ", ".join(f"{w} bigint" for w in WORDS)
    doc_id = F.col("doc_id").cast("bigint")  # pandas would turn a column with NULLs into floats
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(profile, schema).withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``cid`` and ``shingles``, the whole set as sorted hashes."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BATCH):
                part = batch.iloc[at : at + ROWS_PER_BATCH]
                yield pd.DataFrame({"cid": part["doc_id"], "shingles": [shingle_hashes(t, width, words).view(np.int64) for t in part["text"]]})

    return docs.select("doc_id", "text").mapInPandas(sets, "cid bigint, shingles array<bigint>")


def fine_bytes(sets: DataFrame) -> DataFrame:
    """``cid`` and the further counted bytes of ``sets``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, *packed(minima(np.asarray(s, np.int64).view(np.uint64), slice(COUNTED, None)))) for c, s in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["cid", *FINE_WORDS])

    return sets.select("cid", "shingles").mapInPandas(run, "cid bigint, " + ", ".join(f"{w} bigint" for w in FINE_WORDS))


def crowds(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` fall in each of BUCKETS buckets, so in all those of a common one."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BATCH):
                each = np.concatenate(batch["shingles"].iloc[at : at + ROWS_PER_BATCH].to_numpy())
                n += np.bincount(each & (BUCKETS - 1), minlength=BUCKETS)
        full = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": full, "n": n[full]})

    found = sets.select("shingles").mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def rare_shingles(sets: DataFrame, crowd: np.ndarray, percent: int) -> DataFrame:
    """``cid``, ``n``, ``token``, ``place``, ``short``: the rarest 1-s of each set's ``n`` shingles, rarity by ``crowd``
    and then by value, ``place`` from 0; ``short`` marks those that it also shows as the smaller one of two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BATCH):
                part = batch.iloc[at : at + ROWS_PER_BATCH]
                tokens, places, short = [], [], []
                for shingles in part["shingles"]:
                    n = len(shingles)
                    as_larger, as_smaller = n + 1 - -(-percent * n // 100), n + 1 - -(-2 * percent * n // (100 + percent))
                    first = np.lexsort((shingles, crowd[shingles & (BUCKETS - 1)]))[: min(n, as_larger)]
                    tokens.append(shingles[first])
                    places.append(np.arange(len(first)))
                    short.append(np.arange(len(first)) < as_smaller)
                rows = pd.DataFrame({"cid": part["cid"], "n": part["shingles"].map(len)})
                rows = rows.loc[rows.index.repeat([len(t) for t in tokens])]
                yield rows.assign(token=np.concatenate(tokens), place=np.concatenate(places), short=np.concatenate(short))

    return sets.select("cid", "shingles").mapInPandas(run, "cid bigint, n bigint, token bigint, place bigint, short boolean")


def threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The most matches that two sets at exactly ``percent`` similarity reach but for odds of ``miss``."""
    s, below, t = percent / 100, 0.0, 0
    while (below := below + comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)) <= miss:
        t += 1
    return t


def collisions(a: str, b: str, words: list[str]) -> Column:
    """In how many coordinates the rows ``a`` and ``b`` agree: zero bytes of the exclusive or."""
    low7, high = F.lit(0x007F7F7F7F7F7F7F), F.lit(0x0080808080808080)

    def differing(w: str) -> Column:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        return F.bit_count((x.bitwiseAND(low7) + low7).bitwiseOR(x).bitwiseAND(high))

    return F.lit(len(words) * PER_WORD) - reduce(add, [differing(w) for w in words])


def only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the distinct ``ids`` (column ``cid``)."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select(F.col("cid").alias("__id"))
    return df.join(F.broadcast(ids) if few else ids, F.col(key) == F.col("__id"), "left_semi")


class NearDuplicates:
    """The search over one table of documents; see the module's text."""

    def __init__(self, docs: DataFrame, width: int, percent: int, exact: bool = False):
        self.docs, self.width, self.percent, self.exact = docs, width, percent, exact
        self.least, self.least_posted = threshold(COUNTED, percent), threshold(POSTED, percent)
        self.least_of_all = threshold(COUNTED + FINE, percent)
        self.profiles = kept(profiles(docs, width), "profiles")
        usable = self.profiles.filter("n_shingles > 0 and doc_id is not null")
        self.classes = kept(usable.groupBy("key").agg(F.min("doc_id").alias("cid")), "classes")
        heads = usable.join(self.classes, (usable["key"] == self.classes["key"]) & (usable["doc_id"] == self.classes["cid"]))
        self.heads = kept(heads.select("cid", "n_shingles", "posted", *WORDS), "heads")
        self.postings = kept(self._postings(), "postings")
        involved = kept((self.classes if exact else self.postings).select("cid").distinct(), "involved")
        texts = only(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", involved)
        self.sets = kept(shingle_sets(texts, width), "sets")
        self.counted = kept(only(self.heads, "cid", involved).drop("posted"), "counted")
        self.components = kept(involved.select("cid", F.col("cid").alias("component")), "components")

    def _postings(self) -> DataFrame:
        """``token`` and ``cid``: every class under its rarest (coordinate, value) pairs that others have too."""
        tokens = self.heads.select("cid", F.posexplode("posted").alias("c", "v")).select(
            "cid", (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v")).alias("token")
        )
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        lists = (
            tokens.join(shared.hint("merge"), "token").groupBy("cid")
            .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
        )  # at most POSTED entries each
        # pairs of their own come first among the rarest
        prefix = POSTED - self.least_posted + 1 - (POSTED - F.size("t"))
        return lists.filter(prefix > 0).select("cid", F.explode(F.slice("t", F.lit(1), prefix)).alias("t")).select("cid", "t.token")

    def located(self) -> DataFrame:
        """Postings with the component that their class belongs to so far."""
        return self.postings.join(self.components, "cid")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """``a``, ``b`` of those candidate pairs whose whole sets are similar enough."""
        pairs = kept(pairs, "candidates")
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        sets = only(self.sets, "cid", kept(ids, "candidate-ids"))
        first = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("one"))
        second = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("other"))
        both = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
        common = F.size(F.array_intersect("one", "other"))
        sizes = both.select("a", "b", common.alias("common"), (F.size("one") + F.size("other")).alias("all"))
        return sizes.filter(100 * F.col("common") >= self.percent * (F.col("all") - F.col("common"))).select("a", "b")

    def alike(self, a: str, b: str) -> Column:
        """Whether sizes allow the similarity and enough coordinates agree."""
        few, many = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
        return (100 * few >= self.percent * many) & (collisions(a, b, WORDS) >= self.least)

    def merge(self, links: DataFrame) -> None:
        """Join the components that ``links`` connect."""
        at = self.components
        ends = links.join(at.select(F.col("cid").alias("a"), F.col("component").alias("ca")), "a")
        ends = ends.join(at.select(F.col("cid").alias("b"), F.col("component").alias("cb")), "b")
        found = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = at.join(found, at["component"] == found["node"], "left")
        self.components = kept(moved.select("cid", F.coalesce(found["component"], at["component"]).alias("component")), "components")

    def compare(self, pairs: DataFrame) -> None:
        """Count the collisions of ``pairs`` (``a`` < ``b``), confirm those with enough and merge their components."""
        a, b = self.counted.alias("x"), self.counted.alias("y")
        near = pairs.join(a.hint("merge"), F.col("a") == F.col("x.cid")).join(b.hint("merge"), F.col("b") == F.col("y.cid"))
        self.merge(self.confirmed(near.filter(self.alike("x", "y")).select("a", "b")))

    def hub_round(self, number: int) -> None:
        """Compare the members of each list with one of them: the smallest at first, others by a hash later."""
        located = self.located()
        order = F.col("cid") if number == 0 else F.xxhash64("cid", F.lit(number))
        hubs = located.groupBy("token").agg(
            F.min_by("cid", order).alias("hub"), F.min_by("component", order).alias("hub_component"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).filter("low < high").drop("low", "high")
        met = located.join(hubs.hint("merge"), "token").filter("component <> hub_component")
        self.compare(met.select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct())

    def last_round(self) -> None:
        """Compare all members of each list that are outside its largest component with all of the list."""
        located = self.located()
        parts = located.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("token").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"),
            (F.sum("n") - F.max("n")).alias("outside"),
        ).filter("parts > 1").select("token", "main", (F.col("outside") > LONG_LIST).alias("long"))
        main = kept(main, "lists")
        crowded = kept(located.join(main.filter("long").hint("merge"), "token").select("cid").distinct(), "crowded")
        if not crowded.isEmpty():
            self.compare(self.meet_by_shingles(crowded))
            located = self.located()
        tokens = self.postings.groupBy("cid").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        left = located.join(main.filter("not long").hint("merge"), "token")
        fine = fine_bytes(only(self.sets, "cid", kept(left.select("cid").distinct(), "left")))
        rows = kept(
            left.join(self.counted.hint("merge"), "cid").join(fine.hint("merge"), "cid").join(tokens.hint("merge"), "cid"), "rest"
        )
        x, y = rows.filter("component <> main").alias("x"), rows.alias("y")
        # two outside the largest component meet once, and each pair only under the first token they share; if
        # that one's list is long, they met by their shingles
        once = (F.col("y.component") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid"))
        close = collisions("x", "y", WORDS + FINE_WORDS) >= self.least_of_all
        first = F.array_min(F.array_intersect("x.tokens", "y.tokens")) == F.col("x.token")
        met = x.join(
            y.hint("merge"),
            (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & once & self.alike("x", "y") & close & first,
        )
        self.merge(self.confirmed(met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))))

    def meet_by_shingles(self, members: DataFrame) -> DataFrame:
        """``a`` and ``b`` of all pairs of ``members`` (``cid``) in different components that may be similar enough."""
        sets = only(self.sets, "cid", members)
        rows = rare_shingles(sets, crowds(sets), self.percent)
        rows = kept(rows.join(self.components.hint("merge"), "cid"), "rare")
        some = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("short").alias("short"))
        some = some.filter("low < high and short").select("token")
        rows = rows.join(some.hint("merge"), "token", "left_semi")
        parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
        rows = kept(rows.join(main.hint("merge"), "token").withColumn("inside", F.col("component") == F.col("main")).drop("main"), "rare-lists")
        # members of a list's largest component meet those outside, these meet all
        sides = F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        x, y = rows.filter("short").withColumn("side", F.explode(sides)).alias("x"), rows.alias("y")
        smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
        # of the first shingle that two sets have in common, none before it is, so they share what is left at most;
        # pairs that are similar enough have enough left there, whatever they have at later ones
        left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
        met = x.join(
            y.hint("merge"),
            (F.col("x.token") == F.col("y.token")) & (F.col("x.side") == F.col("y.inside"))
            & (F.col("x.component") != F.col("y.component"))
            & smaller & ((100 + self.percent) * left >= self.percent * (F.col("x.n") + F.col("y.n"))),
        )
        return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()

    def run(self) -> DataFrame:
        """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
        for number in range(HUB_ROUNDS):
            self.hub_round(number)
        if self.exact:
            self.merge(self.confirmed(self.meet_by_shingles(self.components.select("cid"))))
        else:
            self.last_round()
        of_class = self.classes.join(self.components.withColumnRenamed("cid", "__cid"), F.col("cid") == F.col("__cid"), "left")
        of_class = of_class.select("key", F.coalesce("component", "cid").alias("component"))
        rows = self.profiles.select("doc_id", "n_shingles", "key").join(of_class, "key", "left")
        found = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
        return rows.select("doc_id", "n_shingles", F.coalesce(found, "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): the component of near-duplicates it belongs to.

    Words are what stands between ASCII white space, A-Z in lower case; a set holds the distinct shingles of
    ``width`` words, or the whole of a shorter text. Two documents are linked when
    100 * common >= percent * all shingles of both. Columns: doc_id, n_shingles, component_id (the smallest doc_id
    reachable), kept (doc_id = component_id). Texts without words, NULL ones too, are linked with nothing. Rows
    without doc_id are linked with nothing either, have no component_id and are kept. Rows that share a doc_id
    are one document with several texts, linked by any of them. Other columns are not looked at; an empty table
    gives no rows. ``exact`` finds the links that signatures miss (see the module's text) by another pass over
    all shingle sets.
    """
    rows = NearDuplicates(docs, width, percent, exact).run()
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` that are kept: one of each component, the one with the smallest doc_id."""
    found = near_duplicates(docs, width, percent)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') w from documents),
s as (
  select doc_id, case when len(w) >= 3 then list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end x from w),
e as (select doc_id, unnest(x) x from s),
c as (select a.doc_id a, b.doc_id b, count(*) n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from c join s p on p.doc_id = a join s q on q.doc_id = b where 100 * n >= 85 * (len(p.x) + len(q.x) - n)),
g as (select a, b from l union all select b, a from l),
r(node, root) as (select doc_id, doc_id from s union select g.b, r.root from r join g on g.a = r.node)
select doc_id, cast(len(x) as bigint) n_shingles, min(root) component_id, doc_id = min(root) kept
from s join r on r.node = doc_id group by doc_id, x
"""
