import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcause.llm.toxicity import (
    FIXED_WEIGHT, SYMBOLS, Lexicon, drop_toxic, fit, fit_curve, fitted, grammar, inflected, machines, op1_clause_toxicity, toxicity_scores,
)

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lexicon():
    return Lexicon({"idiot$": 3.0, "grumbl": 2.0})


def test_clauses(lexicon):
    one = lexicon.clauses
    assert one("what an idiot!") == [3.0]
    assert one("you idiot") == [4.5]  # next to a target
    assert one("not an idiot") == [pytest.approx(0.9)]
    assert one("he said you are an idiot") == [pytest.approx(2.25)]
    assert one("idiotic, semiidiot") == []  # whole words only where so marked
    assert one("a grumbling man") == [2.0]  # word beginnings
    assert one("idiot. fine words here. idiot, idiot") == [3.0, 3.0, 3.0]
    assert one("kill the weeds") == []
    assert one("i will kill you") == [FIXED_WEIGHT]
    assert one("") == one("...") == []


def test_negation_ends_with_its_clause_and_reach(lexicon):
    assert lexicon.clauses("never, idiot") == [3.0]
    assert lexicon.clauses("not that it would matter idiot") == [3.0]


def test_quoted_and_reported_speech(lexicon):
    one = lexicon.clauses
    for text in (
        "he said, you are an idiot", 'he said: "you are an idiot"', '"you are an idiot", he said', '"you are an idiot!" he said.',
        "“you are an idiot”, the old man told us", "you are an idiot, she wrote yesterday",
    ):
        assert one(text) == [pytest.approx(2.25)], text
    assert one('you are an "idiot"') == [4.5] and one('not an "idiot"') == [pytest.approx(0.9)]
    assert one("he said so. you are an idiot") == [4.5]  # a report ends with its sentence
    assert one('"fine", he said. "you are an idiot"') == [4.5]
    assert one("you are an idiot, she called the whole police force") == [4.5]
    assert one('he said "you are an idiot", she said') == [pytest.approx(2.25)]  # not lowered twice
    assert one("he said, idiot, idiot") == [1.5, 1.5]


def test_contractions_and_inflected_threats(lexicon):
    one = lexicon.clauses
    assert one("you aren't an idiot") == one("you aren’t an idiot") == [pytest.approx(1.35)]
    assert one("isn't an idiot") == one("isnt an idiot") == [pytest.approx(0.9)]
    assert one("the idiot's hat") == [3.0] and one("you're an idiot") == [4.5]
    assert one("he kills you") == one("killing you") == one("kill you") == one("choking you slowly") == [FIXED_WEIGHT]
    assert one("stabbing, you") == one("killing time") == []
    assert inflected("stab") == ["stab", "stabs", "stabbing"] and inflected("crush")[1:] == ["crushes", "crushing"]
    assert inflected("beat")[2] == "beating" and inflected("murder")[2] == "murdering" and inflected("strangle")[2] == "strangling"


def test_composition_equals_its_machines():
    r, whole, parts = random.Random(3), grammar(), machines()
    for _ in range(300):
        state, states = 0, [0] * len(parts)
        for s in r.choices(SYMBOLS, k=30):
            state, factor, added = whole[state, s]
            steps = [m[q, s] for m, q in zip(parts, states, strict=True)]
            states = [x[0] for x in steps]
            assert factor == pytest.approx(math.prod(x[1] for x in steps)) and added == pytest.approx(sum(x[2] for x in steps))


def test_composition_is_small(lexicon):
    states = {q for q, _ in lexicon.arcs}
    assert states == set(range(len(states))) and len(states) <= 6 * 5 * 4 * 2
    assert all(n in states for n, _, _ in lexicon.arcs.values())


def accuracy(spark, df, label):
    rows = df.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_held_out_documents(spark):
    df = op1_clause_toxicity(spark, FOLDER)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(spark, df, "toxic") >= 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    model = fitted(spark, FOLDER)
    rows = toxicity_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    empty = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.5
    assert toxicity_scores(no_docs, model).collect() == []
    out = drop_toxic(odd_docs, model)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    bad = spark.createDataFrame([(1, "You idiot, you worthless clown. Idiot!", "x")], "doc_id long, Text string, score string")
    assert drop_toxic(bad, model).count() == 0


def test_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, text string, y int")
    model = fit(none)
    assert model.score("a fine day") < 0.5 < model.score("you stupid idiot. worthless scum, you loser")
    one_kind = odd_docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("y"))
    assert fit(one_kind).score("a fine day") < 0.5


def test_curve_where_whole_newton_steps_overshoot():
    # a few clean texts with very heavy clauses
    random = np.random.default_rng(0)
    y = (np.arange(2000) < 100).astype(float)
    some = (y == 1) | (random.random(2000) < 0.3)
    most = np.where(y == 1, random.uniform(5, 12, 2000), random.uniform(1, 3, 2000)) * some
    most[-5:] = 60
    count = np.where(y == 1, random.integers(1, 9, 2000), 1) * (most > 0)
    x = np.column_stack([np.log1p(most * count), most, np.log1p(count), 0.7 * (most > 0)])
    curve = np.array(fit_curve(x, y))
    design = np.column_stack([x, np.ones(2000)])
    p = 1 / (1 + np.exp(-design @ curve))
    assert p[y == 1].min() > np.quantile(p[y == 0], 0.99)
    assert abs(design.T @ (p - y) + 0.5 * curve * [1, 1, 1, 1, 1e-6]).max() < 1e-4  # the least of the penalised loss
