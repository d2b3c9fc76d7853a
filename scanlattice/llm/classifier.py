"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A document's score is ``w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``
through a logistic: all pairwise interactions in time linear in the words, by the
sum-of-squares identity.  ``x`` holds the document's distinct words and word endings, hashed
and scaled by their length-normalised log counts, and its structure and size statistics.
Language, source, id and labels are never inputs.

The model is fitted on at most ``SAMPLE`` labelled rows (a documented bound), chosen by a
hash of the id, from outside the held-out fold.  Scoring is one narrow pass over all rows.

Defined results: a null text counts as empty and is scored from its statistics alone; a
null id counts as held out or not by the checksum of an empty text.  Without labelled rows
every score is the prior, 1/2.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, named, text_of
from .sample import fold, labelled

FOLDS = 5
THRESHOLD = 0.3
SAMPLE = 6000
BUCKETS = 1 << 14
RANK = 8
_WORD = re.compile(WORD)
_END = re.compile(r"[^\w]+$")
_MARKS = re.compile(r"[!?]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
STATISTICS = 12
_KNOWN: dict[str, tuple[int, int]] = {}


def _hashes(word: str) -> tuple[int, int]:
    """The buckets of a word and of the marks it ends in (-1 without)."""
    got = _KNOWN.get(word)
    if got is None:
        if len(_KNOWN) > 300_000:
            _KNOWN.clear()
        end = _END.search(word)
        got = _KNOWN[word] = (zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"end " + end[0].encode()) % BUCKETS if end else -1)
    return got


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        sum(map(len, words)) / n,
        len(_SYMBOLS.findall(text)) / n,
        len(_UPPER.findall(text)) / chars,
        len(_MARKS.findall(text)) / n,
        len(_DIGIT.findall(text)) / chars,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets, values, statistics) of a whole text."""
    words = _WORD.findall(text)
    counts = Counter(words)
    at: Counter = Counter()
    for word, n in counts.items():
        a, b = _hashes(word)
        at[a] += n
        if b >= 0:
            at[b] += n
    index = np.fromiter(at, np.int32, len(at))
    value = np.log1p(np.fromiter(at.values(), np.float32, len(at)))
    norm = np.sqrt((value**2).sum())
    return index, value / norm if norm else value, statistics(text, words, counts)


@dataclass
class FactorisationMachine:
    """Weights of the buckets, then of the standardised statistics."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def empty(cls) -> FactorisationMachine:
        n = BUCKETS + STATISTICS
        return cls(0.0, np.zeros(n, np.float32), np.zeros((n, RANK), np.float32), np.zeros(STATISTICS), np.ones(STATISTICS))

    def rows(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, first entry of each row) with the statistics appended to each row."""
        own = np.arange(BUCKETS, BUCKETS + STATISTICS, dtype=np.int32)
        stats = np.clip((np.array([s for _, _, s in found]).reshape(-1, STATISTICS) - self.mean) / self.scale, -5, 5) / 4
        index = np.concatenate([x for i, _, _ in found for x in (i, own)]) if found else np.zeros(0, np.int32)
        value = np.concatenate([x for (_, v, _), s in zip(found, stats) for x in (v, s)]) if found else np.zeros(0)
        size = np.array([len(i) + STATISTICS for i, _, _ in found], np.int64)
        return index, value.astype(np.float32), np.cumsum(size) - size

    def raw(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, factor sums, weighted factors), by the sum-of-squares identity."""
        part = self.v[index] * value[:, None]
        sums = np.add.reduceat(part, begin, axis=0)
        squares = np.add.reduceat(part**2, begin, axis=0)
        linear = np.add.reduceat(self.w[index] * value, begin)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, part

    def predict(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        score, _, _ = self.raw(*self.rows([features(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(score.astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, found: list[tuple], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """Adaptive stochastic gradient on the logistic loss."""
        model = cls.empty()
        if not len(found):
            return model
        rng = np.random.default_rng(seed)
        stats = np.array([s for _, _, s in found])
        model.mean, model.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        model.v = rng.normal(0, 0.02, model.v.shape).astype(np.float32)
        share = np.clip(labels.mean(), 0.01, 0.99)
        model.bias = float(np.log(share / (1 - share)))
        gw, gv = np.full(len(model.w), 1e-6, np.float32), np.full(model.v.shape, 1e-6, np.float32)
        gb = 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(found))
            for at in range(0, len(order), 128):
                own = order[at : at + 128]
                index, value, begin = model.rows([found[i] for i in own])
                score, sums, part = model.raw(index, value, begin)
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[own]).astype(np.float32) / len(own)
                row = np.repeat(np.arange(len(own)), np.diff(np.append(begin, len(index))))
                e = (error[row] * value)[:, None]
                dw, dv = np.zeros_like(model.w), np.zeros_like(model.v)
                np.add.at(dw, index, e[:, 0])
                np.add.at(dv, index, e * (sums[row] - part))
                used = np.unique(index)
                dw, dv = dw[used] + decay * model.w[used], dv[used] + decay * model.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += float(error.sum()) ** 2
                model.w[used] -= rate * dw / np.sqrt(gw[used])
                model.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
                model.bias -= rate * float(error.sum()) / gb**0.5
        return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fits on the sample; features are taken on the executors and only they are collected."""
    rows = labelled(docs, labels, label, fold(id_col, folds) != held_out, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "label": batch.column(2),
                    "i": pa.array([i for i, _, _ in found], pa.list_(pa.int32())),
                    "x": pa.array([x for _, x, _ in found], pa.list_(pa.float32())),
                    "s": pa.array([s for _, _, s in found], pa.list_(pa.float64())),
                }
            )

    got = rows.mapInArrow(run, "doc_id long, label int, i array<int>, x array<float>, s array<double>").toArrow()
    got = got.sort_by("doc_id")
    found = [(np.array(i, np.int32), np.array(x, np.float32), s) for i, x, s in zip(*(got.column(c).to_pylist() for c in ("i", "x", "s")))]
    return FactorisationMachine.fit(found, got.column("label").to_numpy().astype(np.float64))


def scorer(model: FactorisationMachine):
    """A column function: the score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = [t if isinstance(t, str) else "" for t in texts]
        return pd.Series(np.concatenate([np.zeros(0), *(model.predict(own[at : at + 256]) for at in range(0, len(own), 256))]))

    return score


def classify(docs: DataFrame, model: FactorisationMachine, folds: int = FOLDS, held_out: int = 0, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    own: Column = scorer(model)(text_of(text_col))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"), own.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
