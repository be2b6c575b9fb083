import random
import zlib

import numpy as np
import pytest

from granary.llm import positives as P

from .helpers import ODD, clashing, documents

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=5):
    """Plain prose, and one in five documents of doubled words, shouts, symbols or tables; whether it is good."""
    rng = random.Random(seed)
    words = ["the", "of", "and", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    texts, good = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.choice([20, 80, 300]))
        kind = i % 20
        text = ". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)).capitalize() + "."
        text = {0: " ".join(x for x in w for _ in "ab"), 1: " ".join(w).upper() + "!!", 2: " ".join(x + "$$$" for x in w), 3: " | ".join(w)}.get(kind, text)
        texts.append(text)
        good.append(int(kind > 3))
    return texts, good


def learned(spark, texts, good, share=2):
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % share == 0 or not g], LABELS)
    return P.classify(documents(spark, texts), labels)


def test_held_out_accuracy_and_columns(spark):
    texts, good = corpus()
    rows = learned(spark, texts, good).collect()
    assert [c for c in learned(spark, texts, good).columns] == ["doc_id", "held_out", "score", "predicted"]
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == good[r.doc_id] for r in kept]) >= 0.97


def test_bad_labels_and_held_out_labels_are_not_learned_from(spark):
    texts, good = corpus(300)
    docs = documents(spark, texts)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    trusted = [(i, 1, 0) for i, g in enumerate(good) if g and not out(i)]
    other = [(i, 0, 1) for i, g in enumerate(good) if not g] + [(i, 1 - g, 0) for i, g in enumerate(good) if out(i)] + [(None, 1, 0), (3, None, 0)]
    one = sorted(P.classify(docs, spark.createDataFrame(trusted, LABELS)).collect())
    two = sorted(P.classify(docs.repartition(5), spark.createDataFrame(trusted + other, LABELS)).collect())
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert np.allclose([r.score for r in one], [r.score for r in two], atol=1e-9)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior(share):
    rng = np.random.default_rng(1)
    score = lambda good: np.clip(rng.normal(0.7 if good else 0.25, 0.1), 0, 1)
    trusted = np.array([score(True) for _ in range(4000)])
    every = np.array([score(rng.random() < share) for _ in range(20_000)])
    of = lambda x: np.histogram(x, P.BINS, (0, 1))[0]
    assert abs(P.class_prior(of(trusted), of(every)) - share) < 0.04


def test_risk_of_the_bad_part_stays_near_zero_or_above():
    rng = np.random.default_rng(2)
    good = rng.normal(1, 0.3, (500, 3))
    every = np.vstack([rng.normal(1, 0.3, (800, 3)), rng.normal(-1, 0.3, (200, 3))])
    for prior in (0.8, 0.95):  # the second is too high, so the estimate would go below zero
        w = P.minimise(good, every, prior)
        bad = np.logaddexp(0, every @ w[:-1] + w[-1]).mean() - prior * np.logaddexp(0, good @ w[:-1] + w[-1]).mean()
        assert bad > -0.02
        s = P.sigmoid(every @ w[:-1] + w[-1])
        assert s[:800].min() > s[800:].max() if prior == 0.8 else s[:800].mean() > s[800:].mean()


def test_features_by_hand():
    x = dict(zip(P.FEATURES, P.features(b"The the a\na\n\na b! #b 7\n")))
    assert x["words"] == np.log1p(8) and x["upper case"] == 1 / 11 and x["doubled words"] == 2 / 8 and x["repeated lines"] == 0
    assert x["stop words"] == 5 / 8 and x["lines a word"] == 3 / 8 and x["symbols a word"] == x["shouts a word"] == 1 / 8 and x["digits"] == 1 / 23
    for t in ODD:
        assert np.isfinite(P.features(None if t is None else t.encode())).all()


def test_odd_tables(spark):
    texts, good = corpus(60)
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], LABELS)
    docs = documents(spark, ODD + texts)
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars"))
    rows = P.classify(clashing(docs), labels.selectExpr("*", "1 AS _id", "2 AS q", "3 AS x").union(labels.selectExpr("*", "1", "2", "3"))).collect()
    assert len(rows) == 3 * len(ODD + texts) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    none = spark.createDataFrame([], LABELS)
    assert P.classify(documents(spark, []), labels).count() == 0
    assert {r.score for r in P.classify(documents(spark, ODD), none).collect()} == {0.5}
    assert len(P.classify(documents(spark, ODD), spark.createDataFrame([(3, 1, 0)], LABELS)).collect()) == len(ODD)
