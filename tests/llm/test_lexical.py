import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import lexical as X

from .helpers import ODD, clashing, documents

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, k=20):
    docs = [(i, Counter(split(t)), len(split(t))) for i, t in texts]
    docs = [d for d in docs if d[2]]
    total, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item_id, text in items:
        scores = []
        for i, tf, n in docs:
            m = 100 - 25 + (25 * n * total) // length
            w = lambda t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item_id, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(docs, items, **more):
    return sorted(map(tuple, X.search(docs, items, **more).collect()), key=str)


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.choice([1, 3, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize(("docs", "posts"), [(8192, 10**6), (37, 10**6), (10, 50)])
def test_equals_brute_force_at_any_block_size(spark, monkeypatch, docs, posts):
    monkeypatch.setattr(X, "BLOCK_DOCS", docs)
    monkeypatch.setattr(X, "BLOCK_POSTINGS", posts)
    texts = corpus(400) + ["w1 w2 w3"] * 30  # many equal scores
    items = [(0, "w1 W2 w2, w59"), (1, "w40 w41 w42 w43 w44"), (2, "w0"), (3, "none"), (3, "w1 w1 w50"), (None, "w3-w4"), (3, "w1 w1 w50")]
    got = searched(documents(spark, texts).repartition(3), spark.createDataFrame(items, ITEMS))
    assert got == brute(list(enumerate(texts)), items)


def test_odd_texts_ids_and_columns(spark):
    rows = [(None, "one two"), (None, "one"), (5, "ONE two ünï"), (5, "ONE two ünï"), *enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, "one"), (2, None), (3, ""), (4, "Ünï CÖDÉ word"), (5, "a_b c" * 9), (6, "¿qué? K x")]
    table = spark.createDataFrame(items, ITEMS)
    assert searched(clashing(docs), table.selectExpr("*", "1 AS q", "2 AS rank", "3 AS _query")) == brute(rows, items)


def test_empty_tables_and_several_turns(spark, monkeypatch):
    texts = corpus(50)
    items = [(i, f"w{i} w{i + 1}") for i in range(20)]
    none = spark.createDataFrame([], ITEMS)
    assert searched(documents(spark, texts), none) == searched(documents(spark, []), spark.createDataFrame(items, ITEMS)) == []
    monkeypatch.setattr(X, "QUERY_BYTES", 100)
    assert searched(documents(spark, texts), spark.createDataFrame(items, ITEMS), k=3) == brute(list(enumerate(texts)), items, 3)


def test_reading_stops_early_and_completes_the_scores():
    """One document holds the rare terms often: the groups of the frequent ones are not all read."""
    found = [np.array([0, 1] if i else [0, 1, 2, 3]) for i in range(500)]
    times = [np.array([1, 1 + i % 7] if i else [1, 1, 9, 9]) for i in range(500)]
    counts = X.Corpus(500, 5000, np.array([500, 490, 1, 1]))
    block = X.Block(counts, [10] * 500, found, times)
    wanted = np.zeros(4, dtype=np.int64)
    query = [(0, 1), (1, 1), (2, 2), (3, 1)]
    docs, scores = block.search(query, 1, 1, wanted)
    assert docs.tolist() == [0] and not wanted.any()
    assert scores[0] == sum(c * block.impact[:4][t] for t, c in query)
    assert all(a >= b for a, b in zip(-block.level[: block.groups[0][1]], -block.level[1 : block.groups[0][1]]))
