import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcause.llm.bpe import VOCABULARY, codec, encode_documents, op10_byte_bpe, round_trip

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(codec(VOCABULARY).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aab the\n\t\x0b\x1c\x85'st12 éß日🎉.,!-"), max_size=60))
def test_mixed_characters(reference, text):
    assert ids(text) == reference.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(reference, text):
    assert ids(text) == reference.encode_ordinary(text)
    assert codec(VOCABULARY).decode(codec(VOCABULARY).encode(text)) == text.encode()


def test_very_long_pre_token(reference):
    random = np.random.default_rng(1)
    text = "".join(random.choice(list("abcdefgh"), 30_000)) + "a" * 20_000
    assert ids(text) == reference.encode_ordinary(text)


def test_documents(spark, odd_docs, no_docs, reference):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"))

    def digests(text):
        packed = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    want = sorted((str(r.doc_id), *digests(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), *r[1:]) for r in round_trip(docs).collect()) == want
    assert round_trip(no_docs).collect() == []
    assert all(bytes(r.decoded).decode() == (t or "") for r, t in zip(encode_documents(odd_docs).collect(), [r.text for r in odd_docs.collect()], strict=True))
    assert op10_byte_bpe(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_results_leave_in_blocks():
    import pandas as pd

    from shipcause.llm.bpe import ROWS_AT_ONCE, VOCABULARY, codec, coded_blocks

    texts = pd.Series([f"text {i} é" for i in range(ROWS_AT_ONCE * 2 + 3)])
    blocks = list(coded_blocks(codec(VOCABULARY), iter([texts, texts[:0], texts[:1]])))
    assert [len(b) for b in blocks] == [ROWS_AT_ONCE, ROWS_AT_ONCE, 3, 1]
    assert [x.decode() for b in blocks for x in b["decoded"]] == [*texts, texts[0]]
