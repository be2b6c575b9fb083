import hashlib
import random

import pytest
from tokenizers import Tokenizer

from granary.llm import bpe as B

from .helpers import ODD, clashing, documents

TEXTS = [
    *ODD, "Hello <|endoftext|>World<|startoftext|> it's the U.S.A. 1234 don't!", "a b   c　d", " ", "é ́x ΑΣ ΑΣ. İstanbul ǅ ﬁ Straße",
    "日本語 テキスト 한국어", "🙂👍🏽 emoji‍zwj", "<|endoftext|><|endoftext|>", "<|endof text|>", "\x00\x01 ctrl \x1c sep \x85 nel", "x" * 300 + " " + "y'll " * 100,
]


def library(texts):
    t = Tokenizer.from_file(B.default_path())
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        yield ids, t.decode(ids, skip_special_tokens=False)


def texts():
    rng = random.Random(2)
    marks = ["́", "'s", "'", "Σ", " ", " ", "\t", "<|endoftext|>", "é", "İ", "1", "½", "-", "日", "​", "A", "z", "\n"]
    return TEXTS + ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(300)]


@pytest.mark.parametrize("limit", [B.TABLE_WORDS, 5])
def test_equals_the_library(spark, limit, monkeypatch):
    monkeypatch.setattr(B, "TABLE_WORDS", limit)
    want = list(library(texts()))
    table = B.WordTable(B.default_path(), limit)
    for (ids, decoded), (a, b) in zip(want, table.texts([None if t is None else t.encode() for t in texts()])):
        assert b"".join(i.to_bytes(4, "little") for i in ids) == a and decoded.encode() == b


def test_queries_and_round_trip(spark):
    docs = documents(spark, texts())
    want = list(library(texts()))
    for r in B.round_trip(clashing(docs)).collect():
        ids, decoded = want[r.doc_id]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    encoded = B.encode(docs)
    assert all(r.ids == want[r.doc_id][0] for r in encoded.collect())
    assert all(r.text == want[r.doc_id][1] for r in B.decode(encoded).collect())


def test_empty_table(spark):
    docs = documents(spark, [])
    assert B.round_trip(docs).count() == B.encode(docs).count() == B.decode(B.encode(docs)).count() == 0


def test_query_encodes_a_word_once_among_many(spark, tmp_path, monkeypatch):
    """The query's table holds what a task of real size meets; the rows are those of the smaller table."""
    import types

    from granary.llm import queries

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(path)
    want = sorted(map(tuple, B.round_trip(spark.read.parquet(path)).collect()))
    asked = []
    counted = types.SimpleNamespace(round_trip=lambda docs, **k: asked.append(k) or B.round_trip(docs, **k), ALONE_WORDS=B.ALONE_WORDS)
    monkeypatch.setattr(queries, "bpe", counted)
    assert sorted(map(tuple, queries.op5_bpe_round_trip(spark, str(tmp_path)).collect())) == want
    table, encoded = B.WordTable(B.default_path(), asked[0]["words"]), []
    entries = table._entries
    table._entries = lambda words: encoded.extend(words) or entries(words)
    words = [b"w%d" % i for i in range(150_000)]
    for _ in range(2):
        for at in range(0, len(words), 10_000):
            table._learn(set(words[at : at + 10_000]))
    assert len(encoded) == len(words)
