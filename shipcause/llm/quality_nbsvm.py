"""Quality scores by a linear support vector machine over n-grams that are scaled by naive Bayes.

Features are indicators of n-grams: words, and runs of one to three word shapes (what case, digits, marks and
repetition a token has; a long shape counts as several in a row). Each is multiplied by its log-count ratio, how much likelier it is in good documents
than in poor ones. A hinge-loss machine is fitted to these by dual coordinate descent: one document at a time,
its dual variable is set to the best value between 0 and C. A logistic curve over its margin makes a score.

The model is fitted on a bounded sample of labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import held_out, kept, labelled_sample, ship_package, table

#: Labelled documents to learn from, n-grams in the model, documents an n-gram must occur in.
SAMPLE, VOCABULARY, LEAST = 8_000, 40_000, 4
THRESHOLD = 0.3
#: Symbols of a shape, tokens whose shapes are remembered, and their longest.
PIECE, REMEMBERED, REMEMBERED_LENGTH = 12, 200_000, 100

_LETTERS = [(re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x"), (re.compile(r"\d+"), "9")]
_RUNS = re.compile(r"(\W)\1{2,}")


def shape(token: str) -> str:
    """``Shape!!!`` gives ``Xx!!``: letters by case, digits as 9, marks as they are, runs of one mark cut to two."""
    for pattern, by in _LETTERS:
        token = pattern.sub(by, token)
    return _RUNS.sub(r"\1\1", token)


class Shapes(dict):
    def __missing__(self, token: str) -> str:
        value = shape(token)
        if len(token) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            value = self[token] = sys.intern(value)  # few shapes for many tokens
        return value


def ngrams(text: str, shapes: Shapes) -> set:
    """The distinct n-grams of a text: words as strings, shapes as tuples of one to three.

    A token that repeats the one before has the shape '='. A shape of more than ``PIECE`` symbols counts as its
    successive pieces, so a text without white space is seen to its end.
    """
    tokens = text.split()
    found = [*map(shapes.__getitem__, tokens)]
    for i in [i for i, (a, b) in enumerate(zip(tokens, tokens[1:]), 1) if a == b]:  # noqa: B905
        found[i] = "="
    if max(map(len, found), default=0) > PIECE:
        found = [f[i : i + PIECE] for f in found for i in range(0, len(f), PIECE)]
    out: set = set(text.lower().split())
    out.update(zip(found), zip(found, found[1:]), zip(found, found[1:], found[2:]))  # noqa: B905
    return out


def as_key(ngram: str | tuple) -> str:
    return ngram if isinstance(ngram, str) else "\x00".join(("", *ngram))


@dataclass
class Model:
    """Weights per n-gram, with the log-count ratios multiplied in, and the curve over the margin."""

    weights: dict
    bias: float
    slope: float
    offset: float

    def margin(self, grams: set) -> float:
        return self.bias + math.fsum(self.weights[g] for g in grams & self.weights.keys())

    def score(self, grams: set) -> float:
        z = self.slope * self.margin(grams) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: np.ndarray, epochs: int = 30, tolerance: float = 0.05) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + sum c_i max(0, 1 - y_i w.x_i).

    ``rows`` are the n-grams of each document, x their ``scale`` and a 1 for the bias. Dual coordinate descent in
    random order; stops when no projected gradient of an epoch is above ``tolerance``.
    """
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(rows))
    x = [np.append(scale[r], 1.0) for r in rows]
    at = [np.append(r, len(scale)) for r in rows]
    norm = np.array([v @ v for v in x])
    random = np.random.default_rng(5)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)).tolist():
            g = y[i] * (w[at[i]] @ x[i]) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= c[i] else g
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - g / norm[i], 0.0), c[i])
                w[at[i]] += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst <= tolerance:
            break
    return w


def fit_curve(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve that makes ``y`` (0 or 1) likeliest; Newton steps, smoothed targets."""
    p1, p0 = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, p1, p0)
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(sample: DataFrame, vocabulary: int = VOCABULARY, least: int = LEAST) -> Model:
    """A model of ``sample`` (``doc_id``, ``text``, ``y``), which is bounded.

    Counting is a job over the sample; the n-grams with the strongest ratios and, per document, their numbers
    come to the driver. A sample without both labels gives a model that scores the share of label 1.
    """
    spark = sample.sparkSession
    ship_package(spark)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            for at in range(0, len(batch), 200):
                found: dict = {}
                for text, label in batch[["text", "y"]].iloc[at : at + 200].itertuples(index=False):
                    for g in ngrams(text, shapes):
                        found.setdefault(g, [0, 0])[label] += 1
                yield pd.DataFrame([(as_key(g), *n) for g, n in found.items()], columns=["gram", "n0", "n1"])

    sample = kept(sample, "labelled")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t0 or not t1:
        return Model({}, 0.0, 0.0, math.log((t1 + 1) / (t0 + 1)))
    found = sample.mapInPandas(counts, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 1) / (t1 + 2.0)) - F.log((F.col("n0") + 1) / (t0 + 2.0))
    strong = found.filter(F.col("n0") + F.col("n1") >= least).withColumn("r", ratio)
    strength = F.abs("r") * F.sqrt(F.col("n0") + F.col("n1"))
    grams = strong.orderBy(strength.desc(), "gram").limit(vocabulary).select("gram", "r").toPandas()
    numbers = {g: i for i, g in enumerate(grams["gram"])}
    scale = grams["r"].to_numpy()

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            rows = []
            for text, label in batch[["text", "y"]].itertuples(index=False):
                rows.append((label, sorted(numbers[k] for g in ngrams(text, shapes) if (k := as_key(g)) in numbers)))
            yield pd.DataFrame(rows, columns=["y", "grams"])

    data = sample.orderBy("doc_id").mapInPandas(numbered, "y int, grams array<int>").toPandas()
    rows = [np.asarray(g, np.int64) for g in data["grams"]]
    y = data["y"].to_numpy()
    # length is no sign of quality: each document's features are scaled to the same norm by its own number
    weight = np.where(y > 0, 0.5 / t1, 0.5 / t0) * len(y)
    folds = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):  # margins for the curve come from models that have not seen the document
        train = np.flatnonzero(folds != k)
        w = fit_hinge([rows[i] for i in train], 2.0 * y[train] - 1, scale, weight[train])
        for i in np.flatnonzero(folds == k):
            margins[i] = w[rows[i]] @ scale[rows[i]] + w[-1]
    w = fit_hinge(rows, 2.0 * y - 1, scale, weight)
    slope, offset = fit_curve(margins, y)
    strings = {g: tuple(g.split("\x00")[1:]) if g.startswith("\x00") else g for g in numbers}
    weights = {strings[g]: float(w[i] * scale[i]) for g, i in numbers.items() if w[i]}
    return Model(weights, float(w[-1]), slope, offset)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, the higher the likelier good) for every whole text; NULL counts as ''."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # at most VOCABULARY weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, shapes = shared.value, Shapes()
        for texts in batches:
            yield pd.Series([own.score(ngrams(t, shapes)) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row; only ``doc_id`` and ``text`` are read.

    Repeated rows stay, texts that are NULL or empty get the score of no n-grams, an empty table gives no rows.
    """
    rows = score_documents(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{[c.lower() for c in columns].index('text')}"
    scored = score_documents(named.withColumn("text", F.col(text)), model)
    return scored.filter(F.col("score") >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    return fit(labelled_sample(spark, sf_dir, "quality", SAMPLE))


def op4_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
