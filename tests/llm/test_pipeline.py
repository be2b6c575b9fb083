import hashlib
import random
from array import array

import pytest

import corpus_pipeline as C
from granary.llm import bpe

from .helpers import ODD, clashing, documents
from .test_decontaminate import slow as slow_contained
from .test_jaccard import edited, slow_keepers
from .test_pii import slow_base
from .test_toxicity import slow_train_and_score


def test_stages_one_after_another(spark, tmp_path):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    text = lambda n=60: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: text() for i in range(300)}
    for i in range(0, 300, 4):
        texts[i] += " idiot scum moron"
    texts |= {1000: texts[1], 1001: texts[1], 1002: None, 1003: ""}
    item = text(20)
    texts[2000] = text() + " " + item + " " + text()
    texts[2001] = text() + " mail joe@example.com"
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    want = {i for i in texts if i >= 300 or i % 4} - {1000, 1001, 1003, 2000}
    assert set(rows) == want
    left = C.redact_personal_data(spark, docs.where("doc_id = 2001"), str(tmp_path))
    assert rows[2001].ids_sha256 == bpe.round_trip(left).first().ids_sha256 != bpe.round_trip(docs.where("doc_id = 2001")).first().ids_sha256
    assert [f(spark, docs, str(tmp_path)).columns for _, f in C.STAGES[:-1]] == [docs.columns] * 4


def slow_pipeline(texts, items, labels):
    """The stages one after another, by the brute-force versions of their operators."""
    from tokenizers import Tokenizer

    scores = slow_train_and_score(texts, labels)
    texts = {i: t for i, t in texts.items() if scores[i] < 0.5}
    keep = slow_keepers(texts)
    texts = {i: t for i, t in texts.items() if i in keep}
    leaks = {d for d, _ in slow_contained(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in leaks}
    tokenizer, out = Tokenizer.from_file(bpe.default_path()), {}
    for i, t in texts.items():
        parts, at = [], 0
        for kind, a, b in slow_base(t or ""):
            if a >= at:
                parts += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        ids = tokenizer.encode("".join([*parts, (t or "")[at:]]), add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
    return out


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(15)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: text(rng.randrange(20, 90)) for i in range(260)}
    labels = {}
    for i in range(200):
        labels[i] = int(i % 4 == 0)
        if labels[i]:
            texts[i] += " you idiot. scum moron"
    for i in range(200, 230):
        texts[i] = edited(rng, words, texts[i - 29], rng.randrange(1, 6))
    items = {1: text(20), 2: text(3), 3: text(60)}
    for i in range(230, 245):
        texts[i] += " " + items[1 + i % 3] + " " + text(5)
    for i in range(245, 260):
        texts[i] += rng.choice([" mail joe@example.com now", " call +1 (555) 123-4567", " at 10.1.2.3", " card 4111 1111 1111 1111 a@b.co"])
    texts |= {900 + i: t for i, t in enumerate(ODD)}
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in C.run(spark, str(tmp_path)).collect()}
    want = slow_pipeline(texts, items, labels)
    assert 100 < len(want) < 230 and rows == want


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, empty tables."""
    docs = documents(spark, [] if empty else [*ODD, "you are an idiot and scum"])
    blank = docs.selectExpr("CAST(NULL AS LONG) doc_id", "text", "CAST(NULL AS STRING) lang", "CAST(NULL AS STRING) source", "CAST(NULL AS LONG) n_chars")
    docs = clashing(docs.union(docs).union(blank))
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    n, distinct = docs.count(), len({" ".join((t or "").lower().split()) for t in ODD}) + 1
    # by its shingles "a b c a b c a b c" is no copy of "a b c"
    for (name, stage), left in zip(C.STAGES, (n - 3, distinct, n, n, n)):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == (0 if empty else left), name
        assert out.columns == (docs.columns if name != "bpe encoding" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
