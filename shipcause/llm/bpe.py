"""Byte-level BPE: encode texts to token ids and decode them, by the ranks of a public tokenizer.

A text is cut into pre-tokens by the tokenizer's pattern. Within a pre-token the adjacent pair of lowest
rank is merged first, the leftmost one among equals. The pairs wait in one bucket per rank; a hierarchical
bitmap over the ranks tells the lowest bucket in use with two find-first-set steps, and the parts are a
linked list, so a pre-token of n bytes takes O(n log n) steps however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import ship_package, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens up to so many characters are remembered, twice so many of them at most per worker.
REMEMBERED_CHARS, REMEMBERED = 48, 300_000
#: Texts that are encoded at once.
ROWS_AT_ONCE = 500
BIT = [1 << i for i in range(4096)]


class Pieces(dict):
    """Packed ids of the pre-tokens seen lately, in two generations: what is still used moves to the new one."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        self.merge, self.old = merge, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.merge(piece.encode())
            packed = pack(f"<{len(ids)}I", *ids)
            if len(piece) > REMEMBERED_CHARS:
                return packed
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Codec:
    """Ranks of one vocabulary file, with the ids of pre-tokens seen lately.

    The queue of waiting pairs: ``buckets`` holds the position under each rank, or a heap of several. Each bit of a word of
    ``low`` marks a rank in use, each bit of the top number a word of ``low``; words have 256 bits, so two
    find-first-set steps, which isolate the lowest bit, reach any of 65,536 ranks, and the top number grows beyond.
    Buckets and words are empty again after each pre-token.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.low = [0] * ((max(self.ranks.values(), default=0) >> 8) + 1)
        self.buckets: dict[int, int | list[int]] = {}
        self.pieces = Pieces(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        rank_of, n, low, buckets, top = ranks.get, len(piece), self.low, self.buckets, 0
        ends = list(range(1, n + 1))  # ends[i]: where the part that starts at i ends; the next part starts there
        before = list(range(-1, n))  # before[i]: where the part before i starts
        fresh = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        while True:
            for rank, i in fresh:
                if rank not in buckets:
                    buckets[rank] = i
                    word = rank >> 8
                    low[word] |= BIT[rank & 255]
                    top |= BIT[word]
                elif type(bucket := buckets[rank]) is int:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            if not top:
                break
            word = (top & -top).bit_length() - 1
            bits = low[word]
            least = bits & -bits
            rank = word << 8 | least.bit_length() - 1
            i = buckets[rank]
            if type(i) is not int:
                heap = i
                i = heappop(heap)
                if len(heap) == 1:
                    buckets[rank] = heap[0]
            else:
                del buckets[rank]
                low[word] = bits ^ least
                if bits == least:
                    top ^= BIT[word]
            fresh = []
            j = ends[i]
            if j >= n or rank_of(piece[i : (end := ends[j])]) != rank:
                continue  # one of the two parts has been merged elsewhere meanwhile
            ends[i], ends[j] = end, n  # j starts no part any more
            if end < n:
                before[end] = i
                if (rank := rank_of(piece[i : ends[end]])) is not None:
                    fresh.append((rank, i))
            if (left := before[i]) >= 0 and (rank := rank_of(piece[left:end])) is not None:
                fresh.append((rank, left))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """The codec of a public vocabulary, read once per Python worker from the installed package."""
    import public_tokenizers

    return Codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def encode_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of a string column as binary, four little-endian bytes each; NULL and '' give no ids."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(vocabulary)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def decode_ids(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes that ids (as ``encode_ids`` gives them) stand for; NULL gives none."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(vocabulary)
        for each in batches:
            yield pd.Series([own.decode(bytes(x)) for x in each], dtype=object)

    return decode(F.coalesce(ids, F.lit(b"")))


def coded_blocks(own: Codec, batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``ids`` and ``decoded`` of all texts, a few hundred rows at once: a worker holds no more results than that."""
    for texts in batches:
        for at in range(0, len(texts), ROWS_AT_ONCE):
            ids = [own.encode(t) for t in texts.iloc[at : at + ROWS_AT_ONCE]]
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]}, dtype=object)


def coded(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """``ids`` of a string column and what they decode to, ``decoded``, as a struct: both in one pass."""

    @F.pandas_udf("ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from coded_blocks(codec(vocabulary), batches)

    return run(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of every document; whole texts, row by row, no shuffle.

    Repeated rows stay, a NULL id stays NULL, an empty table gives no rows, other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", coded(F.col("text"), vocabulary).alias("c"))
    return rows.select("doc_id", (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"), "c.ids", "c.decoded")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    rows = encode_documents(docs, vocabulary)
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
