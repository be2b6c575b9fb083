import hashlib
import random
from collections import Counter

import pytest

from granary.llm import substrings as R
from granary.llm.suffixes import suffix_array

from .helpers import ODD, clashing, documents


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        t = bytes(rng.randrange(rng.choice([1, 2, 3, 250])) for _ in range(rng.randrange(30)))
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    assert suffix_array([7, 300, 7, 300]) == [2, 0, 3, 1]
    for _ in range(300):
        base = bytes(rng.randrange(3) for _ in range(40))
        t = b"\xff".join(base[rng.randrange(20) :] for _ in range(8))
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    long = b"ab" * 20_000
    assert suffix_array(long)[:2] == [39_998, 39_996]


def slow(texts, n=R.LENGTH):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hashlib.md5(b[i : i + n]).digest() for b in raw.values() for i in range(len(b) - n + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[hashlib.md5(b[i : i + n]).digest()] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(8)
    words = [f"wörd{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, edge, header = text(70), text(200), text(20)
    texts = {i: text(rng.randrange(5, 300)) for i in range(40)}
    base = text(600)
    for i in range(100, 125):  # near copies
        w = base.split()
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    for i in range(200, 230):
        texts[i] = text(30) + " " + passage[rng.randrange(30) :] + " " + text(30)
    for i in range(300, 310):
        texts[i] = header + text(100)
    for k, cutting in enumerate([399, 400, 401, 402]):
        texts[400 + 2 * k], texts[401 + 2 * k] = text(10) + edge.encode()[:cutting].decode(errors="ignore") + text(9), "x" + edge.encode()[:cutting].decode(errors="ignore") + "y" * 300
    texts |= {500: "ab" * 600, 501: "z" * 401, 502: "q" * 400, 503: "line of text\n" * 200, 504: base, 505: base, 506: base}
    return texts | {1000 + i: t for i, t in enumerate(ODD)}


@pytest.mark.parametrize("limits", [{}, {"GROUP_CONTEXTS": 3, "ARRAY_SYMBOLS": 5000, "BROADCAST_BYTES": 0}, {"PIECE": 700}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(R, k, v)
    texts = corpus()
    rows = R.remove_repeats(clashing(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    want = slow(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert sum(1 for w in want.values() if w[2]) > 60


def test_repeated_rows_and_ids(spark):
    t, u = "a quick fox " * 3 + "".join(chr(97 + i * i % 26) + str(i) for i in range(300)), "".join(chr(97 + i * 7 % 26) + str(i * 3) for i in range(300))
    docs = documents(spark, {1: t})
    assert [r.n_removed for r in R.remove_repeats(docs).collect()] == [0]
    assert [r.n_removed for r in R.remove_repeats(docs.union(docs)).collect()] == [len(t)] * 2
    same_id = documents(spark, {1: t}).union(documents(spark, {1: u + t}))
    assert sorted(r.n_removed for r in R.remove_repeats(same_id).collect()) == [len(t)] * 2
    none = docs.union(docs).selectExpr("CAST(NULL AS LONG) doc_id", "text")
    assert [r.n_removed for r in R.remove_repeats(none).collect()] == [len(t)] * 2


def test_empty_table(spark):
    assert R.remove_repeats(documents(spark, [])).count() == 0


def test_operator_gives_spans_and_what_is_left(spark):
    rng = random.Random(5)
    words = [f"ü{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, short = text(80), text(51)
    assert len(passage.encode()) > R.LENGTH > len(short.encode()) + 4
    ends = [(text(20) + c, c + text(20)) for c in "abcdef"]
    texts = {i: a + (passage if i < 3 else short) + z for i, (a, z) in enumerate(ends)}
    texts |= {10: passage * 2, 11: "é" * 300, 12: "x" * 401, 13: "y" * 700, 14: "y" * 700, 15: None, 16: "ab", 17: "a" + "é" * 200 + "ê" * 300, 18: "b" + "é" * 200 + "è" * 300}
    rows = {r.doc_id: r for r in R.without_repeats(documents(spark, texts)).collect()}
    want = slow(texts)
    for i, r in rows.items():
        raw, at, left = (texts[i] or "").encode(), 0, b""
        assert bytes(r.text) == raw
        for a, b in r.spans:
            assert at <= a < b and (a > at or not at)  # ascending, never touching
            left, at = left + raw[at:a], b
        assert bytes(r.kept) == left + raw[at:]
        assert (len(raw), len(raw) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[i]
    assert [tuple(s) for s in rows[13].spans] == [(0, 700)] and rows[15].spans == []
    out = {r.doc_id: r.text for r in R.digest(R.without_repeats(documents(spark, texts))).collect()}
    for i, (a, z) in enumerate(ends):  # a passage of under LENGTH bytes stays, by contract; of a longer one nothing does
        assert out[i] == (a + z if i < 3 else a + short + z)
    assert (out[13], out[15], out[16]) == ("", "", "ab")
    for i in out:
        assert out[i] == bytes(rows[i].kept).decode(errors="replace")


def test_query_returns_what_is_left(spark, tmp_path):
    from granary.llm.queries import QUERIES

    passage = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    documents(spark, {1: "<" + passage + ">", 2: "[" + passage + "]", 3: "alone"}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op2_suffix_array_dedup"](spark, str(tmp_path))
    assert rows.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "<>", 2: "[]", 3: "alone"}
