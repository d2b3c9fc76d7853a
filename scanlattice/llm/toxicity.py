"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

*Log-odds*: words and word beginnings are weighed between toxic and other labelled documents
with an informative Dirichlet prior (their frequency in both together); those that stand out
by ``Z`` standard errors, after enough different words, form the lexicon (copies of one
toxic document repeat a word, but after the same word).  Every other word costs ``DRIFT``.

*Segments*: one linear scan finds all maximal-scoring segments of a whole text.  Between
lexicon words the running total only falls, so only those words are visited.

*Calibration*: a segment of score S in n words is expected ``K n exp(-lambda S)`` times by
chance; lambda solves the background's moment equation and K is set by the segments of other
documents.  The log of that expectation, summed over a document's significant segments, is
its evidence, which a one-dimensional logistic fit turns into a probability.

The sample is bounded by ``SAMPLE`` labelled rows (documented), from outside the held-out
fold, and bounds the lexicon.  Scoring is one narrow pass over all rows.

Defined results: a null text counts as empty; texts without lexicon words take the
probability of no evidence.  Without labelled rows the lexicon is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, named, text_of
from .sample import fold, labelled

FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
SAMPLE = 20_000
Z = 4.0
DRIFT = 0.05
#: A segment counts if it is expected at most this often by chance.
SIGNIFICANT = 0.1
BEGINNINGS = (4, 5, 6)
#: Different preceding words that a token needs: this share of its occurrences, but at least
#: and at most so many.
CONTEXT_SHARE, CONTEXTS, ENOUGH_CONTEXTS = 0.35, 4, 30
_WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> list[str]:
    """A word and its beginnings, told apart by their first character."""
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def _scale(evidence: float) -> tuple[float, float]:
    """What the logistic fit sees: whether there is a significant segment, and how much."""
    return float(evidence > 0), math.log1p(evidence)


@dataclass
class Model:
    lexicon: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    slopes: tuple[float, float] = (0.0, 1.0)
    intercept: float = -2.0
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = max((self.lexicon.get(t, 0.0) for t in tokens(word)), default=0.0)
        return got

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """((first word, last word, score) of every maximal segment, number of words)."""
        words = _WORD.findall(text.lower())
        return maximal_segments([(i, s) for i, w in enumerate(words) if (s := self.weight(w)) > 0]), len(words)

    def evidence(self, text: str) -> float:
        """Sum over significant segments of -log(expected number by chance)."""
        found, n = self.segments(text)
        return self.evidence_of([s for _, _, s in found], n)

    def evidence_of(self, scores: list[float], n: int) -> float:
        chance = [math.log(self.k * max(1, n)) - self.lam * s for s in scores]
        return -sum(e for e in chance if e <= math.log(SIGNIFICANT))

    def probability(self, evidence: float) -> float:
        z = self.intercept + sum(a * x for a, x in zip(self.slopes, _scale(evidence)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        return self.probability(self.evidence(text))


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence of -drift but for positive ``hits``.

    The linear-time method of candidate lists: a new hit joins an earlier candidate when the
    total before it is lower and the total after it is no higher.
    """
    out: list[tuple[float, float, int, int, int]] = []  # (total before, total after, first, last, link)
    total, at = 0.0, 0
    for place, s in hits:
        total -= drift * (place - at)
        before, total, at = total, total + s, place + 1
        first = place
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= before:
                j = out[j][4]
            if j < 0 or out[j][1] >= total:
                out.append((before, total, first, place, j))
                break
            before, first, j = out[j][0], out[j][2], out[j][4]
            while out and out[-1][2] >= first:
                out.pop()
    return [(first, last, after - before) for before, after, first, last, _ in out]


def _counts(rows: DataFrame) -> DataFrame:
    """token, toxic, other: occurrences, and docs: toxic documents with it.

    Each task sums its own rows first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own: Counter = Counter()
                for word, times in Counter(_WORD.findall(text.lower())).items():
                    for t in tokens(word):
                        own[t] += times
                n[0 if label else 1].update(own)
                if label:
                    n[2].update(own.keys())
            every = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_pydict({"token": every} | {c: pa.array([k[t] for t in every], pa.int64()) for c, k in zip(("toxic", "other", "docs"), n)})

    got = rows.mapInArrow(run, "token string, toxic long, other long, docs long")
    return got.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "docs")))


def _contexts(rows: DataFrame, candidates: set[str]) -> dict[str, int]:
    """After how many different words each candidate stands in toxic documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                before = ""
                for word in _WORD.findall(text.lower()):
                    found.update((t, before) for t in tokens(word) if t in candidates)
                    before = word
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.string()) for c, x in zip(("token", "before"), list(zip(*found)) or ([], []))})

    pairs = rows.where("label = 1").select("text").mapInArrow(run, "token string, before string")
    return {r.token: r.n for r in pairs.groupBy("token").agg(F.countDistinct("before").alias("n")).collect()}


def _lambda(chance: list[tuple[float, float]], drift: float = DRIFT) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the background's token scores."""
    rest = 1 - sum(p for p, _ in chance)
    f = lambda lam: sum(p * math.exp(min(700.0, lam * s)) for p, s in chance) + rest * math.exp(-lam * drift) - 1
    low, high = 1e-3, 1e-3
    while f(high) < 0 and high < 20:
        low, high = high, high * 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """(slopes, intercept) by damped Newton steps, with targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([x, np.ones(len(y))])
    beta = np.array([0.0, 0.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-3 * np.eye(3), x.T @ (p - target))
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return (float(beta[0]), max(0.0, float(beta[1]))), float(beta[2])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = materialize(labelled(docs, labels, label, fold(id_col, folds) != held_out, sample, id_col, text_col), "toxicity-sample")
    counted = materialize(_counts(rows), "toxicity-counts")
    sums = counted.where(F.col("token").startswith("=")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    toxic, other = float(sums.toxic or 0), float(sums.other or 0)
    model = Model({})
    if not toxic or not other:
        return model
    # The prior weighs a tenth of the toxic tokens, spread as the token is in both classes.
    prior = 0.1 * toxic
    a = F.lit(prior) * (F.col("toxic") + F.col("other")) / F.lit(toxic + other)
    yt, yo = F.col("toxic") + a, F.col("other") + a
    odds = F.log(yt / (F.lit(toxic + prior) - yt)) - F.log(yo / (F.lit(other + prior) - yo))
    found = counted.where("docs >= 4").select("token", "toxic", "other", odds.alias("odds"), F.sqrt(1 / yt + 1 / yo).alias("se"))
    kept = found.where(F.col("odds") >= Z * F.col("se")).where("odds >= 2").collect()
    contexts = _contexts(rows, {r.token for r in kept})
    kept = [r for r in kept if contexts.get(r.token, 0) >= max(CONTEXTS, min(ENOUGH_CONTEXTS, CONTEXT_SHARE * r.toxic))]
    model.lexicon = {r.token: float(r.odds) for r in kept}
    words = [r for r in kept if r.token[0] == "="]
    model.lam = _lambda([((r.other + 0.5) / (other + 1), float(r.odds)) for r in words])
    lexicon_only = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon_only.segments(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "label": batch.column(2),
                    "n": pa.array([n for _, n in got], pa.int64()),
                    "s": pa.array([[s for _, _, s in x] for x, _ in got], pa.list_(pa.float64())),
                }
            )

    seen = rows.mapInArrow(run, "doc_id long, label int, n long, s array<double>").toArrow().sort_by("doc_id").to_pylist()
    clean = [r for r in seen if not r["label"]]
    chance = [s for r in clean for s in r["s"]]
    least = min((s for r in seen for s in r["s"]), default=1.0)
    model.k = (len(chance) + 0.5) / (max(1, sum(r["n"] for r in clean)) * math.exp(-model.lam * least))
    x = [_scale(model.evidence_of(r["s"], r["n"])) for r in seen]
    model.slopes, model.intercept = _logistic(np.array(x).reshape(-1, 2), np.array([r["label"] for r in seen]))
    return model


def scorer(model: Model):
    """A column function: the probability that a text is toxic."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t if isinstance(t, str) else "") for t in texts], dtype="float64")

    return score


def classify(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"), scorer(model)(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, last_word, score, expected of every significant segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "first_word", "last_word", "score", "expected")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = model.segments(text)
                for first, last, s in found:
                    e = model.k * max(1, n) * math.exp(-model.lam * s)
                    if e <= SIGNIFICANT:
                        for c, v in zip(out, (doc, first, last, s, e)):
                            out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_word long, last_word long, score double, expected double")
