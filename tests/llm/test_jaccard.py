import random

from granary.llm import jaccard as J
from granary.llm import simhash as S

from .helpers import ODD, clashing, documents


def slow_keepers(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in texts}


def edited(rng, words, text, n):
    own = text.split()
    for at in rng.sample(range(len(own)), n):
        own[at] = rng.choice(words)
    return " ".join(own)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for _ in range(40):  # pairs about the threshold
        base = text(rng.randrange(30, 300))
        texts += [base, edited(rng, words, base, max(1, len(base.split()) // rng.choice([30, 45, 60, 100])))]
    base = text(300)
    texts += [edited(rng, words, base, rng.randrange(0, 10)) for _ in range(120)]  # a dense group
    for _ in range(30):  # a chain
        base = edited(rng, words, base, 4)
        texts.append(base)
    common = text(150)
    texts += [common + " " + text(100) for _ in range(30)] + ODD  # much in common, no copies
    rng.shuffle(texts)
    docs = documents(spark, texts)
    want = slow_keepers(dict(enumerate(texts)))
    assert {r.doc_id for r in J.keep_one(clashing(docs)).collect()} == want
    assert len(want) < len({r.component_id for r in S.near_duplicates(docs).collect()})


def test_pairs_left_over_by_the_trees_are_found(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(200))
    texts = [edited(rng, words, base, 3) for _ in range(60)]
    docs = documents(spark, texts)
    monkeypatch.setattr(J, "tree_pairs", lambda key, point: (point[:0], point[:0]))
    assert {r.doc_id for r in J.keep_one(docs).collect()} == slow_keepers(dict(enumerate(texts)))


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(200))
    texts = [edited(rng, words, base, rng.choice([0, 2, 4, 6])) for _ in range(70)]
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    assert {r.doc_id for r in J.keep_one(documents(spark, texts)).collect()} == slow_keepers(dict(enumerate(texts)))


def test_empty_table_and_clashing_names(spark):
    assert J.keep_one(documents(spark, [])).count() == 0
    docs = documents(spark, ["a b c"]).selectExpr("*", "1 AS _doc", "2 AS _text", "3 AS t", "4 AS `best.of`", "5 AS component")
    assert J.keep_one(docs.union(docs)).collect() == docs.collect()
