import math
import random
import re
import zlib

import numpy as np

from granary.llm import toxicity as T

from .helpers import ODD, clashing, documents


def events(text):
    g = T.Grammar({"grob": 3.0})
    out, clause = [], []
    for w in [*text.split(), "."]:
        for s, _ in g.word(w):
            if s == T.END:
                out += [e for _, e in g.events(clause)]
                clause = []
            else:
                clause.append(s)
    return out


def test_composed_transducers():
    assert events("you are an idiot") == [(T.INSULT, False, False, True)]
    assert events("this is not stupid.") == [(T.INSULT, True, False, False)]
    assert events("he said: stupid") == [(T.INSULT, False, False, False)]
    assert events("anna said it is stupid. trash") == [(T.INSULT, False, True, False), (T.INSULT, False, False, False)]
    assert events('the "idiot" thing') == [(T.INSULT, False, True, False)]
    assert events("i will never kill you") == [(T.THREAT, True, False, True)]
    assert events("i will kill you") == [(T.THREAT, False, False, True)] and events("a b c d e kill. you") == [(T.THREAT, False, False, False)]
    assert events("grobian GROBE") == [(T.INSULT, False, False, False)] * 2


def test_clauses_decide_and_not_words(spark):
    """Aimed insults score over bare ones; denied, reported and quoted ones no higher than a text without any; aimed
    threats above it, labels or not."""
    docs, labels, _ = corpus(spark)
    for model in (T.train(docs, labels), T.train(docs, labels.limit(0))):
        for word in ("idiot", "scum", "trash"):
            bare, nothing = model.score(word), model.score("")
            assert model.score(f"you {word}") > bare > nothing and model.score(f"{word}, that is what you are") > bare
            for text in (f"it is not {word}", f"he said {word}", f'the "{word}" thing', f"nobody called you {word}"):
                assert model.score(text) < nothing
        assert model.score("i will kill you") > model.score("i will kill time") > model.score("i will never kill you")
        assert model.score("i will kill you") > 2 * model.score("")
    assert T.train(docs, labels).score("i will kill you") > 0.5


def corpus(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    texts, labels = {}, []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        parts = [rng.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                parts[rng.randrange(40)] = rng.choice(["idiot", "scum.", "blödfisch", "blödhans"])
        texts[i] = " ".join(parts)
        labels.append((i, 1, toxic))
    texts |= {5000 + i: t for i, t in enumerate(ODD)}
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_learns_and_holds_out(spark):
    docs, labels, truth = corpus(spark)
    model = T.train(docs, labels)
    assert any("blöd".startswith(s) or s.startswith("blöd") for s in model.grammar.stems)
    rows = {r.doc_id: r for r in T.score(clashing(docs), model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.predicted, truth[i]) for i, r in rows.items() if r.held_out and i in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {r.doc_id for r in T.reject(docs, model).collect()} == {i for i, r in rows.items() if not r.predicted}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["F"]).expr("CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END"))
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert a.grammar.stems == b.grammar.stems and (a.weights == b.weights).all()


def test_no_labels_and_empty_tables(spark):
    docs, labels, _ = corpus(spark)
    none = T.train(docs, labels.limit(0))
    assert none.score("you idiot") > none.score("good day") and 0 <= none.score(None) < 0.5
    assert T.score(documents(spark, []), none).count() == 0


def slow_train_and_score(texts, truth):
    """The method again, plainly: copies by their least triple, stems by counting, events by looking back and ahead
    from each insult or threat, weights by projected gradient steps."""
    lower = {i: (t or "").lower() for i, t in texts.items()}
    piece = lambda w: re.findall(r"[\w']+", w)
    rows = [i for i in truth if zlib.crc32(str(i).encode()) % 5]
    one = {}
    for i in rows:
        w = lower[i].split()
        if w:
            key = (truth[i], min(zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))))
            assert key not in one or texts[one[key]] == texts[i]
            one[key] = i
    n = [sum(truth[i] == y for i in rows) for y in (0, 1)]
    count = {}
    for i in one.values():
        for s in {p[:k] for w in lower[i].split() for p in piece(w) if not p.isdigit() for k in range(3, min(12, len(p)) + 1)}:
            count.setdefault(s, [0, 0])[truth[i]] += 1
    odds = {s: math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1)) for s, c in count.items()}
    good = {s for s in odds if count[s][1] >= T.STEM_TEXTS and odds[s] >= T.STEM_ODDS}
    stems = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        if not any(s.startswith(k) and s != k for k in stems):
            while more := sorted(x for x in good if x[:-1] == s and count[x][1] >= 0.9 * count[s][1]):
                s = more[0]
            stems[s] = odds[s]

    def features(text):
        tokens = []  # (symbol, weight); None ends a clause
        for w in text.split():
            if w[0] in T.QUOTES:
                tokens.append((T.REPORT, 0))
            for p in piece(w.lower()) or [""]:
                weight = max([v for s, v in stems.items() if p.startswith(s)], default=0)
                kind = T.INSULT if weight > 0 or p in T.INSULTS else T.THREAT if p in T.THREATS else T.NEGATION if p in T.NEGATIONS else T.TARGET if p in T.TARGETS else T.REPORT if p in T.REPORTS else T.OTHER
                tokens.append((kind, weight if weight > 0 else float(p in T.INSULTS)))
            if w[-1] in ".!?;:" + T.QUOTES:
                tokens.append(None)
        clauses, now = [], []
        for t in tokens:
            if t is None:
                clauses.append(now)
                now = []
            else:
                now.append(t)
        clauses += [now] if now else []
        x, hit, weights = [0.0] * T.WIDTH, 0, []
        for c in clauses:
            plain = 0
            for k, (kind, weight) in enumerate(c):
                if kind in (T.INSULT, T.THREAT):
                    near = lambda symbol, back, ahead: any(c[j][0] == symbol for j in range(max(0, k - back), min(len(c), k + ahead + 1)))  # noqa: B023, E731
                    negated, reported, aimed = near(T.NEGATION, 3, 0), near(T.REPORT, k, 0), near(T.TARGET, 5, 5)
                    x[T.EVENTS.index((kind, negated, reported, aimed))] += 1
                    if not negated and not reported:
                        plain = 1
                        weights.append(max(stems.values(), default=1) * aimed if kind == T.THREAT else weight)
                        if aimed:
                            x[T.EVENTS.index((kind, False, False, False))] += 1
            hit += plain
        if not clauses:
            return [0.0] * T.WIDTH
        return [math.log1p(v) for v in x[: len(T.EVENTS)]] + [math.log1p(hit), hit / len(clauses), max(weights, default=0), math.log1p(sum(weights))]

    x = np.array([features(texts[i] or "") for i in rows])
    y = np.array([truth[i] for i in rows], float)
    a = np.hstack([x, np.ones((len(x), 1))])
    keep = np.r_[np.ones(x.shape[1]), 1e-6]
    start, low, high = np.r_[T.PRIOR, -2], np.r_[T.LOWEST, -np.inf], np.r_[T.HIGHEST, np.inf]
    w = start
    step = 1 / (np.linalg.eigvalsh(a.T @ a)[-1] / 4 + 1)
    z, before = w, w
    for k in range(20_000):  # gradient steps with momentum
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) + keep * (z - start)
        w = np.clip(z - step * g, low, high)
        z, before = w + k / (k + 3) * (w - before), w
    return {i: 1 / (1 + math.exp(-float(np.r_[features(t or ""), 1] @ w))) for i, t in texts.items()}


def test_scores_equal_brute_force_however_rows_are_partitioned(spark):
    docs, labels, truth = corpus(spark)
    more = docs.unionByName(docs.where("doc_id < 40").withColumn("doc_id", docs.doc_id + 2000))  # copies with labels
    labels = labels.unionByName(labels.where("doc_id < 40").withColumn("doc_id", labels.doc_id + 2000))
    truth |= {i + 2000: truth[i] for i in range(40)}
    scores = []
    for parts in (1, 8, 31):
        d = more.repartition(parts)
        scores.append({r.doc_id: r.score for r in T.score(d, T.train(d, labels)).collect()})
    assert scores[0] == scores[1] == scores[2]
    want = slow_train_and_score({r.doc_id: r.text for r in more.collect()}, truth)
    assert max(abs(want[i] - s) for i, s in scores[0].items()) < 1e-3


def test_repeats_long_texts_and_the_gate(spark):
    docs, labels, _ = corpus(spark)
    model = T.train(docs, labels)
    long = "word1 word2 " * 100_000
    rows = T.score(documents(spark, [long, long + "idiot", long]), model).collect()
    assert rows[0].score == rows[2].score == model.score(None) < rows[1].score
    for r in docs.collect():
        g = T.Grammar(model.grammar.stems)
        gated = g.features(r.text or "")
        g.may_hold = lambda text: True
        free = g.features(r.text or "")
        assert (gated is None and free is None) or (gated == free).all()
