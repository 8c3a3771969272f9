"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into sentences, and each word becomes a symbol: insult, threat, target, negation, reporting verb or
other; commas and quotation marks are symbols too. Small transducers read the symbols: one counts insults, one
threats that reach a target, one raises what a target stands next to, one lowers what is negated shortly before, one
what is only reported. Their composition is one transducer over the product of their states. A comma, which ends what
negations and targets reach, ends a clause, and what the transducer adds up over a clause is the clause's weight; a
report goes on to the end of the sentence. One that stands at its end ('"...", he said') is found by a small machine
that reads backwards, and then the sentence is read as if the report came first. A document's score is a logistic
curve over the weights of its matched clauses.

Insults are a short fixed list and words and word beginnings learned from labelled documents: a beginning counts
as much as it is likelier in toxic documents than in others, at the lower end of its confidence range.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import held_out, kept, labelled_sample, ship_package, table

#: Labelled documents to learn from; entries of the lexicon at most; documents an entry must occur in.
SAMPLE, LEXICON, LEAST = 12_000, 4_000, 3
#: Lengths of word beginnings; confidence range in standard errors; least weight of an entry; weight of fixed ones.
BEGINNINGS, RANGE, LEAST_WEIGHT, FIXED_WEIGHT = range(4, 10), 1.96, 1.0, 3.0
THRESHOLD = 0.5

#: Word lists of the grammar.
INSULTS = [
    "clown", "creep", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum",
    "stupid", "trash", "vermin", "worthless",
]
THREATS = [
    "attack", "beat", "burn", "butcher", "choke", "crush", "destroy", "hurt", "kill", "murder", "shoot", "slaughter", "smash", "stab",
    "strangle",
]
TARGETS = [
    "you", "your", "yours", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "euch", "tu", "toi", "vous", "ils",
    "usted", "ustedes", "ellos",
]
NEGATIONS = [
    "not", "no", "never", "neither", "nor", "without", "cannot", "arent", "cant", "dont", "doesnt", "isnt", "wasnt", "werent", "wont",
    "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "sin",
]
REPORTS = [
    "said", "says", "called", "calls", "told", "tells", "quoted", "wrote", "writes", "claimed", "replied", "shouted", "yelled",
    "reportedly", "sagte", "nannte", "dit", "dijo",
]

WORD = re.compile(r"[^\W\d_]+")
#: Words, those with 't as one; commas and colons, and ends of sentences within a quotation; quotation marks.
TOKEN = re.compile(r"[^\W\d_]+(?:['’]t(?![^\W_]))?|[,:.!?;]+|[\"“”„«»]+")
QUOTES = "\"“”„«»"
SENTENCE_END = re.compile(r"[.!?;\n\r|]+(?![.!?;\n\r|\"”»])")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
COMMA, QUOTE = "comma", "quote"
SYMBOLS = [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, COMMA, QUOTE]


def inflected(verb: str) -> list[str]:
    """The verb, its third person and its -ing form."""
    third = verb + ("es" if verb.endswith(("s", "x", "z", "ch", "sh")) else "s")
    if verb.endswith("e"):
        return [verb, third, f"{verb[:-1]}ing"]
    doubled = re.fullmatch(r"[^aeiou]+[aeiou][^aeiouwxy]", verb)
    return [verb, third, f"{verb}{verb[-1] if doubled else ''}ing"]


THREAT_FORMS = [form for verb in THREATS for form in inflected(verb)]
CLASSES = {w: s for s, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREAT_FORMS)) for w in words}


# ---- transducers ----------------------------------------------------------------

#: (state, symbol) -> (next state, factor on the word's weight, weight added)
Arcs = dict[tuple[int, str], tuple[int, float, float]]


def transducer(states: int, arc: Callable[[int, str], tuple[int, float, float]]) -> Arcs:
    return {(q, s): arc(q, s) for q in range(states) for s in SYMBOLS}


def compose(*machines: Arcs) -> Arcs:
    """All machines over the same symbols at once: factors multiply, additions add up. Start state 0.

    States that cannot be reached are left out.
    """
    numbers: dict[tuple[int, ...], int] = {(0,) * len(machines): 0}
    arcs: Arcs = {}
    todo = [(0,) * len(machines)]
    while todo:
        state = todo.pop()
        for s in SYMBOLS:
            steps = [m[q, s] for m, q in zip(machines, state, strict=True)]
            following = tuple(step[0] for step in steps)
            if following not in numbers:
                numbers[following] = len(numbers)
                todo.append(following)
            arcs[numbers[state], s] = numbers[following], math.prod(x[1] for x in steps), math.fsum(x[2] for x in steps)
    return arcs


def one_on(q: int, s: str) -> int:
    """How far something still reaches after symbol ``s``: a comma ends it, quotation marks are not counted."""
    return 0 if s == COMMA else q if s == QUOTE else max(q - 1, 0)


def within(reach: int, trigger: str, inside: float) -> Arcs:
    """``inside`` is the factor on insults and threats up to ``reach`` words after ``trigger`` in its clause."""

    def arc(q: int, s: str) -> tuple[int, float, float]:
        return reach if s == trigger else one_on(q, s), inside if q and s in (INSULT, THREAT) else 1.0, 0.0

    return transducer(reach + 1, arc)


def machines() -> list[Arcs]:
    insult = transducer(1, lambda q, s: (0, 1.0 if s in (INSULT, THREAT) else 0.0, 0.0))
    # a threat alone weighs nothing; one that reaches a target within five words does
    threat = transducer(6, lambda q, s: (5 if s == THREAT else 0 if s == TARGET else one_on(q, s), 0.0 if s == THREAT else 1.0, FIXED_WEIGHT if q and s == TARGET else 0.0))
    reported = transducer(2, lambda q, s: (1 if s == REPORT else q, 0.5 if q else 1.0, 0.0))
    return [insult, threat, within(4, TARGET, 1.5), within(3, NEGATION, 0.3), reported]


def grammar() -> Arcs:
    return compose(*machines())


def trailing_report(symbols: Sequence[str]) -> bool:
    """Whether a sentence ends in a report of what stands before it.

    Read backwards: at most two words, the verb, at most three words of who speaks, a comma or quotation mark.
    """
    state = 0  # words before the verb; from 3 on, words after it
    for s in reversed(symbols):
        if s in (COMMA, QUOTE):
            return state >= 3
        if s == REPORT and state < 3:
            state = 3
        elif s in (INSULT, THREAT) or state in (2, 6):
            return False
        else:
            state += 1
    return False


# ---- texts ----------------------------------------------------------------------


@dataclass
class Lexicon:
    """Weights of word beginnings and of whole words, which end with '$'; finds them by an Aho-Corasick automaton."""

    weights: dict[str, float]
    arcs: Arcs = field(default_factory=grammar)
    automaton: object = None

    def __post_init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry in [*self.weights, *(f"{t}$" for t in THREAT_FORMS)]:
            word = entry.removesuffix("$")
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()
        self.lengths = sorted({len(e) for e in self.weights if not e.endswith("$")})

    def __reduce__(self):
        return Lexicon, (self.weights,)  # the automaton is made again in each worker

    def weight(self, word: str) -> float:
        """Of the entries that the word is or starts with, the largest weight; 0 without one."""
        own = self.weights.get(f"{word}$", 0.0)
        return max([own, *(self.weights.get(word[:n], 0.0) for n in self.lengths if n <= len(word))])

    def symbol(self, token: str) -> tuple[str, float]:
        """What the grammar reads for a token, and its weight."""
        if token[0].isalpha():
            if token[-2:] in ("'t", "’t"):
                return NEGATION, 0.0
            weight = self.weight(token)
            return (INSULT if weight else CLASSES.get(token, OTHER)), weight
        return (QUOTE if token[0] in QUOTES else COMMA), 0.0

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses of a lower-case text in which something matched."""
        hits = []
        for end, word in self.automaton.iter(text):
            start = end - len(word)  # of the character before
            if start < 0 or not text[start].isalpha():
                hits.append(start + 1)
        if not hits:
            return []
        ends = [m.start() for m in SENTENCE_END.finditer(text)]
        found = []
        for k in sorted({bisect_left(ends, h) for h in hits}):
            sentence = text[ends[k - 1] + 1 if k else 0 : ends[k] if k < len(ends) else len(text)]
            read = [self.symbol(t) for t in TOKEN.findall(sentence)]
            state, total = 0, 0.0
            if trailing_report([s for s, _ in read]):
                state = self.arcs[state, REPORT][0]
            for symbol, weight in [*read, (COMMA, 0.0)]:
                state, factor, added = self.arcs[state, symbol]
                total += weight * factor + added
                if symbol == COMMA:
                    if total > 0:
                        found.append(total)
                    total = 0.0
        return found

    def features(self, text: str) -> list[float]:
        """What the curve sees: the sum and the largest of the clause weights, how many, and the text's length."""
        text = text.lower()
        found = self.clauses(text)
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        size = math.log1p(len(text) / 1000)
        return [math.log1p(math.fsum(found)), max(found), math.log1p(len(found)), size]


def beginnings(text: str) -> set[str]:
    """Whole words, marked by '$', and word beginnings of a text."""
    words = set(WORD.findall(text.lower()))
    out = {f"{w}$" for w in words if len(w) > 2}
    for n in BEGINNINGS:
        out.update(w[:n] for w in words if len(w) > n)
    return out


# ---- learning and scoring ---------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    curve: list[float]

    def score(self, text: str) -> float:
        z = self.curve[-1] + math.fsum(b * x for b, x in zip(self.curve, self.lexicon.features(text), strict=False))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries and weights from ``sample`` (``text``, ``y``), counted by Spark; the strongest come to the driver.

    A longer beginning is left out where a shorter one says as much.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                found: dict[str, list[int]] = {}
                for text, label in batch[["text", "y"]].iloc[at : at + 200].itertuples(index=False):
                    for entry in beginnings(text):
                        found.setdefault(entry, [0, 0])[label] += 1
                yield pd.DataFrame([(e, *n) for e, n in found.items()], columns=["entry", "n0", "n1"])

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    found = sample.mapInPandas(counts, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 0.5) / (t1 + 1.0)) - F.log((F.col("n0") + 0.5) / (t0 + 1.0))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    strong = found.filter(F.col("n1") >= LEAST).select("entry", (ratio - RANGE * error).alias("weight")).filter(F.col("weight") >= LEAST_WEIGHT)
    rows = strong.orderBy(F.desc("weight"), "entry").limit(LEXICON).collect()
    learned = {r["entry"]: r["weight"] for r in rows}
    weights = {f"{w}$": FIXED_WEIGHT for w in INSULTS}
    for entry, weight in sorted(learned.items(), key=lambda x: len(x[0])):
        word = entry.removesuffix("$")
        if all(weights.get(word[:n], 0.0) < weight for n in BEGINNINGS if n < len(word) or entry.endswith("$") and n == len(word)):
            weights[entry] = max(weight, weights.get(entry, 0.0))
    return weights


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Logistic regression with an unpenalised offset, by Newton steps, halved until the penalised loss falls."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.diag([1.0] * x.shape[1] + [1e-6])
    beta = np.zeros(design.shape[1])
    beta[-1] = math.log((y.sum() + 1) / ((1 - y).sum() + 1))

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.logaddexp(0, z).sum() - y @ z + b @ penalty @ b / 2)

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty @ beta)
        while abs(step).max() >= 1e-8 and loss(beta + step) > now:
            step /= 2
        if abs(step).max() < 1e-8:
            break
        beta += step
        now = loss(beta)
    return beta.tolist()


def fit(sample: DataFrame) -> Model:
    """A model of ``sample`` (``doc_id``, ``text``, ``y``), which is bounded: no other text is looked at.

    Without any labelled row the fixed lists score with a curve that their weights alone decide.
    """
    spark = sample.sparkSession
    ship_package(spark)
    sample = kept(sample, "labelled")
    lexicon = Lexicon(learn_lexicon(sample))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], **{f"f{i}": [r[i] for r in rows] for i in range(4)}})

    data = sample.mapInPandas(features, "y int, f0 double, f1 double, f2 double, f3 double").toPandas()
    if data["y"].nunique() < 2:
        return Model(lexicon, [1.0, 1.0, 0.0, 0.0, -FIXED_WEIGHT])
    data = data.sort_values(list(data.columns))  # the same sums in any order of partitions
    return Model(lexicon, fit_curve(data[["f0", "f1", "f2", "f3"]].to_numpy(), data["y"].to_numpy(float)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, the higher the likelier toxic) for every whole text; NULL counts as ''."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # at most LEXICON entries

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row; only ``doc_id`` and ``text`` are read.

    Repeated rows stay, texts that are NULL or empty get the score of no match, an empty table gives no rows.
    """
    rows = score_documents(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{[c.lower() for c in columns].index('text')}"
    scored = score_documents(named.withColumn("text", F.col(text)), model)
    return scored.filter(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    return fit(labelled_sample(spark, sf_dir, "toxic", SAMPLE))


def op1_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
