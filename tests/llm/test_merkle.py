import hashlib
import zlib

import pytest

from granary.llm import merkle as M

from .helpers import ODD, SCHEMA, clashing, documents


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The top of a tree, and for each node its siblings before and after, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for q, i in enumerate(at):
            run = runs[i // 3]
            paths[q].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[q] = i // 3
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: tree([leaf(*r) for r in by[s]]) for s in order}
    root, crown = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, beyond in zip(order, crown):
        for r, own in zip(by[s], trees[s][1]):
            path = own + beyond
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r[0], r[1].replace("\n", "") if even and r[1] is not None else r[1], *r[2:])
            for a, b in path:
                h = digest(a + h + b)
            out.append((r[0], leaf(*r), trees[s][0], root, digest("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def audited(docs):
    return sorted((tuple(r)[:7] for r in M.audit(docs).collect()), key=str)


@pytest.mark.parametrize("steps", [1, 2])
def test_small_blocks_equal_brute_force(spark, monkeypatch, steps):
    monkeypatch.setattr(M, "STEPS", steps)
    monkeypatch.setattr(M, "SPAN", 3**steps)
    rows = [(i, f"a{i % 9}\nb" if i % 4 else ODD[i % len(ODD)], "en", None if i % 23 == 0 else "hot" if i % 3 else f"ß{i % 7}", i) for i in range(130)]
    assert audited(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5)) == brute(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(1, "x\n", "en", "s", 2)] * 5 + [(1, "y", None, "s", None), (None, None, None, None, None), (None, "\n", "de", "s", 1), (-2, "", "", "", 0), (7, "\n", "", "s", 0)]
    assert audited(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_row_one_source_and_none(spark):
    for rows in ([(3, "a\nb", "en", "s", 3)], [(i, "t", "en", "s", 1) for i in range(4)], [(i, "t", "en", f"s{i}", 1) for i in range(4)]):
        assert audited(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert M.audit(documents(spark, [])).count() == 0


def test_paths_prove_leaves_and_nothing_else(spark):
    rows = M.manifest(documents(spark, [f"t{i}" for i in range(800)], lambda i: "one")).collect()
    for r in rows[::37]:
        assert len(r.path) == 7 and all(len(p.preimage) in (64, 128, 192) for p in r.path)
        h = r.leaf
        for p in r.path:
            assert p.preimage[64 * p.slot : 64 * p.slot + 64] == h
            h = digest(p.preimage)
        assert h == r.root == r.subroot
