import random

import numpy as np
import pytest
import xxhash

from granary.llm import jaccard as J
from granary.llm import simhash as S
from granary.llm.components import connected_components

from .helpers import ODD, clashing, documents


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, distance=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(groups[find(k)]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("text", ODD)
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert S.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_golay_decodes_every_word_within_three_bits():
    golay = S.Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    index = golay.index(words)
    codeword = (index << 11) | golay.parity[index]
    assert (np.bitwise_count(codeword ^ words) <= 3).all()
    near = golay.nearby(words, 23)
    assert ((near >= 0).sum(axis=1) <= 6).all() and (near == index[:, None]).any(axis=1).all()


def test_pairs_within_three_bits_share_a_key():
    rng, golay = random.Random(1), S.Golay()
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        key, row, own = S.golay_keys(np.array([a, b], dtype=np.uint64).view(np.int64), golay)
        assert set(key[(row == 0) & own]) & set(key[row == 1])


def test_components_on_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(5, 5), (6, 5), (300, 300)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(6, 60)}


def test_few_edges_take_no_rounds_and_more_take_rounds_to_the_same_components(spark, monkeypatch):
    from granary.operators import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(7, None), (300, 300)]
    edges = spark.createDataFrame(edges, "u long, v long").repartition(4)
    checkpoints, signatures = [], []
    cut, sign = components.materialise, components._signature
    monkeypatch.setattr(components, "materialise", lambda df: checkpoints.append(1) or cut(df))
    monkeypatch.setattr(components, "_signature", lambda df: signatures.append(1) or sign(df))
    expected = {i: 100 for i in range(101, 161)} | {i: 5 for i in range(6, 60)}
    assert {r.node: r.root for r in connected_components(edges).collect()} == expected
    assert len(checkpoints) == len(signatures) == 1
    monkeypatch.setattr(components, "CHUNK", 10)
    assert {r.node: r.root for r in connected_components(edges).collect()} == expected
    assert len(checkpoints) > 2


@pytest.fixture
def near(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    texts = []
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.randrange(0, 12)):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    return documents(spark, texts + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)] + ODD)


def test_groups_equal_brute_force(near):
    rows = S.near_duplicates(clashing(near)).collect()
    texts = {r.doc_id: r.text for r in near.collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == slow_components(list(prints), list(prints.values()))


def test_oversized_keys_are_searched_in_blocks(near, monkeypatch):
    whole = sorted(S.near_duplicates(near).collect())
    monkeypatch.setattr(S, "GROUP_ROWS", 20)
    assert sorted(S.near_duplicates(near).collect()) == whole


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ["a b c d"] * 3 + ["x y z"] + [None, ""])
    assert sorted(r.doc_id for r in J.keep_one(docs).collect()) == [0, 3, 4]
    assert J.keep_one(docs.union(docs)).count() == 3
    assert J.keep_one(docs).columns == docs.columns
    none = docs.selectExpr("CAST(NULL AS LONG) doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r.text or "" for r in J.keep_one(none).collect()) == ["", "a b c d", "x y z"]
    same_id = documents(spark, {7: "q w e r t"}).union(documents(spark, {7: "z u i o p", 8: "q w e r t"}))
    assert sorted((r.doc_id, r.text) for r in J.keep_one(same_id).collect()) == [(7, "q w e r t"), (7, "z u i o p")]


def test_empty_table(spark):
    assert S.near_duplicates(documents(spark, [])).count() == 0
