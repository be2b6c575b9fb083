"""Quality by positive-unlabelled learning: trusted good documents against all the web text.

Only documents labelled good are trusted; what is bad is never shown to the model.  Every document, whatever its label,
is unlabelled text, of which an unknown share (the class prior) is good.

* Each text becomes a few shares and lengths (``FEATURES``), each taken plain and under a root, standardised over all
  documents.
* The prior: a plain logistic model tells half of the trusted documents from unlabelled ones; the score bin where the
  ratio of (unlabelled above it) to (the other trusted half above it) is least, with its sampling errors added, bounds
  the share of good documents.  The unlabelled side is a histogram over all documents.
* The classifier: a logistic model g minimises the non-negative unbiased risk
  ``prior * E_good[l(g)] + max(0, E_all[l(-g)] - prior * E_good[l(-g)])``; where the estimate of the bad documents' part
  falls below zero, steps go back up until it is above again.

Fitted on bounded samples: ``GOOD_ROWS`` trusted and ``ALL_ROWS`` unlabelled rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sums import summed
from .common import materialise
from .quality import STOP_WORDS
from .toxicity import held_out

#: Most trusted and most unlabelled rows that the models are fitted on: those with the smallest hashes.
GOOD_ROWS, ALL_ROWS = 20_000, 20_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3
#: Bins of the histogram of scores, and the confidence with which the prior's bound is chosen.
BINS, DOUBT = 1000, 0.1
RIDGE, STEPS, RATE = 1e-3, 300, 0.02
_ASCII = bytes(range(128))
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER, _LOWER, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_SYMBOLS, _SHOUTS, _STOPS, _OTHERS = b"#*$%&|<>", b"!?", b".,;:", b"\"'()[]{}/\\-_+=@~^`"
FEATURES = (
    "words", "word bytes", "longest word", "upper case", "digits", "beyond ASCII", "symbols a word", "shouts a word", "stops a word", "other signs a word",
    "doubled words", "repeated triples", "repeated words", "most frequent word", "stop words", "lines a word", "repeated lines",
)
WIDTH = 2 * len(FEATURES)


def features(text: bytes | None) -> np.ndarray:
    """The features of a text in UTF-8; a null text is an empty one."""
    raw = text or b""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper, lower = count(_UPPER), count(_LOWER)
    times = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    x = np.array([
        np.log1p(len(words)), len(b"".join(words)) / n, np.log1p(max(map(len, times), default=0)),
        upper / max(1, upper + lower), count(_DIGITS) / size, len(raw.translate(None, _ASCII)) / size,
        min(3.0, count(_SYMBOLS) / n), min(3.0, count(_SHOUTS) / n), min(3.0, count(_STOPS) / n), min(3.0, count(_OTHERS) / n),
        sum(map(eq, words, words[1:])) / n, 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        1 - len(times) / n if words else 0.0, max(times.values(), default=0) / n, sum(c for w, c in times.items() if w.lower() in _STOP) / n,
        min(1.0, len(lines) / n), 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
    ])
    return np.concatenate([x, np.sqrt(x)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Means and deviations of the features, a weight for each and a bias; ``prior`` is the share of good documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


def tell_apart(good: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Ridge logistic weights (the bias last) that tell the good rows from all, both sides counting alike."""
    a = np.hstack([np.vstack([good, every]), np.ones((len(good) + len(every), 1))])
    y = np.repeat([1.0, 0.0], [len(good), len(every)])
    share = np.repeat([0.5 / len(good), 0.5 / len(every)], [len(good), len(every)])
    w, keep = np.zeros(a.shape[1]), np.r_[np.full(good.shape[1], RIDGE), 1e-9]
    for _ in range(20):
        p = sigmoid(a @ w)
        w += np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (share * (y - p)) - keep * w)
    return w


def class_prior(good: np.ndarray, every: np.ndarray) -> float:
    """The share of good rows, from histograms of scores over trusted and over all rows: the least ratio of what is
    above a bin in either, each with its sampling error."""
    n, m = good.sum(), every.sum()
    above, all_above = good[::-1].cumsum() / n, every[::-1].cumsum() / m
    error = np.sqrt(np.log(4 / DOUBT) / (2 * n)) + np.sqrt(np.log(4 / DOUBT) / (2 * m))
    bound = np.where(above > 0, (all_above + error) / np.maximum(above, 1e-12), np.inf)
    at = int(bound.argmin())
    return float(min(1.0, all_above[at] / above[at]))


def minimise(good: np.ndarray, every: np.ndarray, prior: float) -> np.ndarray:
    """Weights (the bias last) of least non-negative unbiased risk, by Adam steps over all rows."""
    good, every = (np.hstack([x, np.ones((len(x), 1))]) for x in (good, every))
    w = np.zeros(good.shape[1])
    m, v, keep = np.zeros(len(w)), np.zeros(len(w)), np.r_[np.full(len(w) - 1, RIDGE), 0.0]
    for t in range(1, STEPS + 1):
        a, b = good @ w, every @ w
        bad = np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean()
        down = every.T @ sigmoid(b) / len(b) - prior * (good.T @ sigmoid(a)) / len(a)
        g = (down - prior * (good.T @ sigmoid(-a)) / len(a) if bad >= 0 else -down) + keep * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, WIDTH)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of each row: its features as doubles."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x binary")


def _histogram(rows: DataFrame, model: Model) -> np.ndarray:
    return summed(rows.select("x"), BINS, lambda b: np.histogram(model.score(_rows(b.column(0))), BINS, (0.0, 1.0))[0])


def train(rows: DataFrame, labels: DataFrame, good_rows: int = GOOD_ROWS, all_rows: int = ALL_ROWS) -> Model | None:
    """A model from measured rows and the labelled documents that are not held out; None without a trusted document.

    Trusted are doc_ids that every one of their labels calls good; of rows that repeat a doc_id one counts, and labels
    or rows without a doc_id are not trusted.  The samples don't depend on how the rows are partitioned.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("q")).where("q = 1")
    chosen = known.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(good_rows)
    # at most ``good_rows`` integers; then as many rows of WIDTH doubles, and ``all_rows``
    good = rows.join(F.broadcast(chosen), rows["doc_id"] == F.col("_id")).groupBy("_id").agg(F.min("x").alias("x"))
    good = _rows(good.orderBy(F.xxhash64("_id"), "_id").select("x").toArrow().column(0))
    if not len(good):
        return None
    every = _rows(rows.orderBy(F.xxhash64("x", "doc_id"), "doc_id").select("x").limit(all_rows).toArrow().column(0))

    def moments(b):
        x = _rows(b.column(0))
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    total = summed(rows.select("x"), 2 * WIDTH + 1, moments)
    mean = total[1 : WIDTH + 1] / total[0]
    scale = np.sqrt(np.maximum(total[WIDTH + 1 :] / total[0] - mean**2, 0)) + 1e-6
    good, every = (good - mean) / scale, (every - mean) / scale
    fitted, kept = (good[::2], good[1::2]) if len(good) > 1 else (good, good)
    rough = Model(mean, scale, tell_apart(fitted, every), 1.0)
    above = np.histogram(sigmoid(kept @ rough.weights[:-1] + rough.weights[-1]), BINS, (0.0, 1.0))[0]
    prior = class_prior(above, _histogram(rows, rough))
    return Model(mean, scale, minimise(good, every, prior), prior)


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of measured rows; without a model every score is 0.5."""

    def run(batches):
        for b in batches:
            s = model.score(_rows(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    found = rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of documents, by a model trained on them.

    Null and empty texts get the score of a text without words; repeated rows get equal rows; an empty table gives
    none; a null doc_id stays null and is not held out; only doc_id and text are read.
    """
    rows = materialise(measured(docs))
    return scored(rows, train(rows, labels))
