import random
import re

from granary.llm import decontaminate as D

from .helpers import ODD, clashing, documents


def slow(texts, items, t=0.8):
    cut = lambda x: [w for w in re.split("[\x20\x09-\x0d]+", (x or "").lower()) if w]
    shingles = lambda x, n=5: {" ".join(w[i : i + n]) for w in [cut(x)] for i in range(len(w) - n + 1)}
    out = set()
    whole = {i: (n, shingles(y, n)) for i, y in items.items() if (n := min(5, len(cut(y))))}
    for d, x in texts.items():
        held = {n: shingles(x, n) for n in range(1, 6)}
        out |= {(d, i) for i, (n, s) in whole.items() if len(s & held[n]) >= round(t * len(s), 9)}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 4, 5, 6, 9, 20, 60]))) for i in range(40)}
    texts = {}
    for d in range(150):
        parts = [rng.choice(words) for _ in range(rng.choice([0, 20, 2000]))]
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(40)].split()
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = rng.choice(words)
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = item
        texts[d] = " ".join(parts)
    texts |= {1000 + i: t for i, t in enumerate(ODD)}
    docs, bench = documents(spark, texts), spark.createDataFrame([*items.items(), (77, None), (None, "a b c d e f")], "item_id long, text string")
    want = slow(texts, items)
    assert want and {(r.doc_id, r.item_id) for r in D.contained_items(clashing(docs), bench).collect()} == want
    bad = {texts[d] for d, _ in want}
    left = D.decontaminate(clashing(docs.unionByName(docs.selectExpr("CAST(NULL AS LONG) doc_id", "text", "lang", "source", "n_chars"))), bench)
    assert left.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [d for d, x in texts.items() if x not in bad]
    assert left.where("doc_id IS NULL").count() == sum(x not in bad for x in texts.values())


def test_sketch_bounds(spark):
    text = " ".join(f"w{i}" for i in range(60))
    items = D.item_shingles(spark.createDataFrame([(1, text), (2, "a b"), (3, ""), (4, "a b c d e f")], "item_id long, text string"))
    rows = D.sketch(items).collect()
    assert {(r.partition, r.item_id, r.need) for r in rows} == {(5, 1, 25 - 11), (0, 2, 1), (1, 4, 1)}  # 56 shingles, of which 11 may miss
    assert [sum(r.item_id == i for r in rows) for i in (1, 2, 4)] == [25, 1, 1]


def test_same_without_broadcasts(spark, monkeypatch):
    docs, bench = documents(spark, ["x a b c d e f y", "q"]), spark.createDataFrame([(1, "A b c d e f")], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert [(r.doc_id, r.item_id, r.containment) for r in D.contained_items(docs, bench).collect()] == [(0, 1, 1.0)]


def test_empty_tables(spark):
    docs, bench = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(docs, bench).count() == 0
    assert D.decontaminate(documents(spark, ["a"]), bench).count() == 1
