from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from shipcause.llm.common import labelled_sample
from shipcause.llm.quality_nbsvm import Model, Shapes, drop_poor, fit, fit_curve, fit_hinge, fitted, ngrams, op4_nbsvm_quality, quality_scores, shape

FOLDER = "/root/testdata/sf0.01"


def test_shapes_and_ngrams():
    assert [shape(t) for t in ("Word", "WORD!!!!", "a1b22", "été,", "|")] == ["Xx", "X!!", "x9x9", "x,", "|"]
    found = ngrams("The cat the THE the the", Shapes())
    assert {"the", "cat", ("Xx",), ("x", "x"), ("x", "=")} <= found and "The" not in found
    assert ngrams("", Shapes()) == set()


def test_long_tokens_count_to_their_end():
    model = Model({("{x:9}{x:9}{x",): 1.0, ("#9#9",): -5.0}, 0.0, 1.0, 0.0)
    start = "{ab:12}{cd:3}{ef"
    assert model.margin(ngrams(start, Shapes())) == 1
    assert model.margin(ngrams(start + "-1-x-1-x-1-x" * 500 + "#1#2", Shapes())) == -4
    assert ("a,", "x") not in ngrams("日本、" * 9, Shapes()) and ("x、x、x、x、x、x、", "x、x、x、") in ngrams("日本、" * 9, Shapes())
    assert shape("a-" * 20) == "x-" * 20


def test_hinge_fit_is_optimal():
    random = np.random.default_rng(0)
    dense = random.normal(size=(60, 6)) > 0.3
    y = np.where(dense[:, 0] ^ (random.random(60) < 0.1), 1.0, -1.0)
    scale = random.normal(size=6)
    c = np.full(60, 0.7)
    w = fit_hinge([np.flatnonzero(r) for r in dense], y, scale, c, epochs=3000, tolerance=1e-6)
    x = np.column_stack([dense * scale, np.ones(60)])
    loss = lambda v: v @ v / 2 + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(w) <= loss(w + random.normal(size=7) * s) + 1e-4 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_curve():
    slope, offset = fit_curve(np.array([-2.0, -1, -1, 1, 1, 2] * 20), np.array([0, 0, 1, 0, 1, 1] * 20))
    assert slope > 0 and abs(offset) < 0.1


def test_held_out_documents(spark):
    df = op4_nbsvm_quality(spark, FOLDER)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = df.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in judged) / len(judged) >= 0.95


def test_sample_leaves_out_what_is_held_out(spark):
    rows = labelled_sample(spark, FOLDER, "quality", 50).collect()
    assert len(rows) == 50 and all(crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    model = fitted(spark, FOLDER)
    rows = quality_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert quality_scores(no_docs, model).collect() == []
    out = drop_poor(odd_docs, model)
    assert out.columns == odd_docs.columns
    kept = {r.doc_id for r in quality_scores(odd_docs, model).collect() if r.predicted}
    assert {r.doc_id for r in out.collect()} == kept
    again = fitted(spark, FOLDER)
    assert again.weights == model.weights and again.slope == model.slope


def test_one_label_only(spark, odd_docs):
    one = odd_docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("y"))
    assert fit(one).score(ngrams("anything", Shapes())) > 0.9


def plain_ngrams(text):
    """n-grams by the definition, one character at a time."""

    def plain_shape(token):
        out, i = "", 0
        while i < len(token):
            j = i + 1
            if token[i].isalpha():
                while j < len(token) and token[j].isalpha():
                    j += 1
                run = token[i:j]
                out += "X" if run.isupper() else "Xx" if run[0].isupper() else "x"
            elif token[i].isdigit():
                while j < len(token) and token[j].isdigit():
                    j += 1
                out += "9"
            else:
                while j < len(token) and token[j] == token[i]:
                    j += 1
                out += token[i] * min(j - i, 2) if token[i] != "_" else token[i:j]
            i = j
        return out

    tokens, shapes = text.split(), []
    for before, token in zip([None, *tokens], tokens, strict=False):
        whole = "=" if token == before else plain_shape(token)
        shapes += [whole[i : i + 12] for i in range(0, len(whole), 12)]
    runs = {tuple(shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}
    return runs | {t.lower() for t in tokens}


def test_whole_score_by_brute_force(spark):
    """Ratios, margins and every score, from n-grams counted anew over whole texts; the optimum is tested above."""
    sample = labelled_sample(spark, FOLDER, "quality", 150)
    model = fit(sample)
    rows = [(plain_ngrams(r.text), r.y) for r in sample.collect()]
    total = [sum(y == k for _, y in rows) for k in (0, 1)]
    assert min(total) > 5
    count = {}
    for grams, y in rows:
        for g in grams:
            count.setdefault(g, [0, 0])[y] += 1
    ratio = {g: np.log((n1 + 1) / (total[1] + 2)) - np.log((n0 + 1) / (total[0] + 2)) for g, (n0, n1) in count.items() if n0 + n1 >= 4}
    assert 100 < len(ratio) < 40_000 and model.weights.keys() <= ratio.keys()
    names = sorted((g for g in ratio if ratio[g]), key=str)
    x = np.array([[ratio[g] * (g in grams) for g in names] + [1.0] for grams, _ in rows])
    y = np.array([2.0 * y - 1 for _, y in rows])
    w = np.array([model.weights.get(g, 0.0) / ratio[g] for g in names] + [model.bias])
    assert (y * (x @ w)).min() >= 1 - 0.05  # separable; the fit stops when no margin is short by more than its tolerance
    assert w @ w < 1  # of all machines with such margins one of the flattest: few n-grams would need far larger weights
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_scores(docs, model).collect():
        margin = model.bias + sum(model.weights.get(g, 0.0) for g in plain_ngrams(texts[r.doc_id]))
        score = 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
        assert abs(r.score - score) < 1e-9 and r.predicted == (r.score >= 0.3)
