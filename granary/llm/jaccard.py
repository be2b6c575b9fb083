"""Near copies by the Jaccard similarity of word shingles: SimHash groups and MinHash bands propose, shingle sets decide.

Texts of one shingle set are one point.  Two things propose pairs of points:

* The 64-bit SimHash of the shingle set: points whose fingerprints the Golay search of ``simhash`` links (3 bits).  At a similarity of 0.8 two fingerprints differ in some ten bits, so this finds the closer copies
  only; a search that wide would take over a thousand Golay keys a text (figures in the README).
* MinHashes (BANDS times ROWS), posted band by band, for the rest: a pair at similarity s shares a band with
  probability 1 - (1 - s^ROWS)^BANDS, 0.999997 at 0.8.

Only keys and points are shuffled by band; the MinHashes themselves are joined to the pairs that come of it.  Linked
pairs, and those that share a band and agree in FLOOR of the MinHashes at least, are compared by their shingle sets (as
64-bit hashes).  So that a dense group costs neither the square of its size nor its size for each band, the members of
EARLY bands are first compared along a random tree, in which nobody has more than ARITY children.  Then every band with
members of several components tries one member of each with one of the largest, TRIES times.  After that, only pairs of
one band whose ends lie in different components are left, and all of those are compared.  Bands of over BLOCK_ROWS
members are cut into blocks, for the trees by chance twice over, for what is left so that every pair of blocks meets.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import free, materialise
from .components import connected_components

WIDTH = 5
#: Similarity from which texts are near copies, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 4
#: Estimated similarity under which a pair isn't compared (5.6 standard errors below 0.8 and more).
FLOOR = 0.55
ARITY = 8
#: Bands that trees are put over, and how often single members of what is left apart are tried.
EARLY, TRIES = 4, 2
#: Members of one key that one task compares with each other.
BLOCK_ROWS = 20_000
#: Bytes of shingle sets that one task holds of either side, a set more at most.
BLOCK_BYTES = 32 << 20
SEED = 42
CHUNK = 1024  # shingles that are permuted at once
#: Tables of two or three longs are broadcast up to so many rows (12 MB), and shuffled beyond that.
BROADCAST_ROWS = 500_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    width = min(WIDTH, len(parts))
    joined = b" ".join(parts)
    ends = list(accumulate(len(w) + 1 for w in parts))
    starts = [0, *ends[:-1]]
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], dtype=np.uint64))


def point_of(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long; 0 without shingles."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), simhash.CHUNK):
        part = np.ascontiguousarray(hashes[at : at + simhash.CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def minhashes(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        x = (hashes[None, at : at + CHUNK] ^ _XOR) * _TIMES
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def near_copies(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * shared >= OVER * (len(a) + len(b) - shared)


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id, t, point, fp, bands, sig`` for each row: t is the text's hash, sig a byte of each MinHash."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            points, fps, bands, sigs = [], [], [], []
            for text in b.column(2):
                hashes = shingle_set(text.as_py())
                low = minhashes(hashes)
                points.append(point_of(hashes))
                fps.append(fingerprint(hashes))
                keys = [xxh3_64_intdigest(low[at : at + ROWS].tobytes(), at) for at in range(0, len(low), ROWS)] if len(hashes) else []
                bands.append(np.array(keys, dtype=np.uint64).view(np.int64))
                sigs.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(points, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "t", "point", "fp", "bands", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, point long, fp long, bands array<long>, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def _whole_keys(batches, read):
    """Runs of rows that hold all rows of their keys, from batches sorted by key; ``read`` gives arrays, key first."""
    held = []

    def joined():
        return [np.concatenate(x) for x in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        cols = read(b)
        if held and cols[0][-1] == held[0][0][0] == held[-1][0][-1]:
            held.append(cols)
            continue
        held.append(cols)
        cols = joined()
        cut = np.searchsorted(cols[0], cols[0][-1])
        if cut:
            yield [x[:cut] for x in cols]
        held = [[x[cut:] for x in cols]]
    if held:
        yield joined()


def _alike(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 50_000):
        i, j = a[at : at + 50_000], b[at : at + 50_000]
        out[at : at + 50_000] = (sig[i] == sig[j]).mean(axis=1) >= FLOOR
    return out


def tree_pairs(key: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children and parents in a random tree over the members of each key (rows sorted by key).

    The tree's order is of the points alone, so that bands with the same members make the same pairs.
    """
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    base = np.repeat(first, size)
    place = np.arange(len(key)) - base
    mixed = point.view(np.uint64) * _TIMES[0, 0]
    order = np.lexsort((mixed ^ (mixed >> np.uint64(29)), key))
    child = place > 0
    return point[order[child]], point[order[(base + (place - 1) // ARITY)[child]]]


def cross_links(key, point, sig, root, seeks, hashes):
    """For each seeking member of a key and each other root among its members, one that is a near copy, if any is (rows
    sorted by key)."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for s, n in zip(first, np.diff(np.r_[first, len(key)])):
        others = s + np.flatnonzero(~seeks[s : s + n])
        for i in s + np.flatnonzero(seeks[s : s + n]):
            j = others[root[others] != root[i]]
            j = j[_alike(sig, np.full(len(j), i), j)]
            if not len(j):
                continue
            own, linked = np.frombuffer(hashes[i], np.uint64), set()
            for k in j.tolist():
                if root[k] not in linked and near_copies(own, np.frombuffer(hashes[k], np.uint64)):
                    linked.add(root[k])
                    yield point[i], point[k]


#: Rows of one Arrow batch where every row carries shingle sets.
SET_ROWS = 500


@contextmanager
def _small_batches(spark):
    """Jobs run inside move few rows at once between Spark and Python, as these are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SET_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)``: the pairs whose shingle sets are near copies."""

    def run(batches):
        for b in batches:
            x, y = (b.column(i).to_pylist() for i in (2, 3))
            ok = pa.array([near_copies(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(ok)

    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    one, two = (sets.select(F.col("point").alias(n), F.col("hashes").alias(f"h{n}")) for n in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``point, hashes`` of the texts whose hash t is wanted."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([point_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["point", "hashes"])

    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("binary").alias("text"))
    return texts.join(small(wanted), "t", "left_semi").select("text").mapInArrow(run, "point long, hashes binary").dropDuplicates(["point"])


def _simhash_pairs(points: DataFrame) -> DataFrame:
    """``(u, v)``: the pairs that linked or equal fingerprints propose; one point stands for all of a fingerprint."""
    fps = materialise(points.groupBy("fp").agg(F.min("point").alias("first")))
    links = simhash.hamming_links(fps.select("fp"))
    one, two = (fps.select(F.col("fp").alias(x), F.col("first").alias(f"p{x}")) for x in "uv")
    linked = links.join(one, "u").join(two, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
    equal = points.select("fp", "point").join(fps, "fp").where("point <> first").select(F.col("point").alias("u"), F.col("first").alias("v"))
    return linked.unionByName(equal)


def _along_trees(posted: DataFrame) -> DataFrame:
    """Posts of shared keys (``key, point``), and the pairs (``u, v``) of the trees of early ones; a row is one or the
    other."""

    def run(batches):
        read = lambda b: [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        none = lambda n: pa.nulls(n, pa.int64())
        names = ["key", "point", "u", "v"]
        for block, key, point, deal, early in _whole_keys(batches, read):
            same = block[1:] == block[:-1]
            keep = np.r_[False, same] | np.r_[same, False] | (deal > 0)
            block, key, point, deal, early = block[keep], key[keep], point[keep], deal[keep], early[keep].astype(bool)
            if not len(key):
                continue
            u, v = tree_pairs(block[early], point[early])
            once = deal < 2
            n = int(once.sum())
            yield pa.RecordBatch.from_arrays([pa.array(key[once]), pa.array(point[once]), none(n), none(n)], names=names)
            yield pa.RecordBatch.from_arrays([none(len(u)), none(len(u)), pa.array(u), pa.array(v)], names=names)

    frequent = materialise(posted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("blocks")).where("blocks > 1"))
    # deal 0: a key that fits; deals 1 and 2: a large key's members, dealt into blocks twice
    dealt = posted.join(small(frequent), "key", "left").withColumn("deal", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    block = F.when(F.col("deal") == 0, F.col("key")).otherwise(F.xxhash64("key", "deal", F.pmod(F.xxhash64("point", "deal"), "blocks")))
    dealt = dealt.select(block.alias("block"), "key", "point", "deal", "early")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "key long, point long, u long, v long")


def _alike_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs that agree in FLOOR of their MinHashes at least, each once."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(axis=1) >= FLOOR
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok))

    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    one, two = (sigs.select(F.col("point").alias(n), F.col("sig").alias(f"s{n}")) for n in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _labelled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    return shared.join(roots, shared.point == roots.node, "left").select("key", "point", F.coalesce("root", "point").alias("root"))


def _by_one_each(shared: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """``(u, v)``: for each key with several components, one member of each of them with one of the largest."""
    one = F.min_by("point", F.xxhash64("point", F.lit(seed))).alias("one")
    kinds = materialise(_labelled(shared, roots).groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), one))
    mixed = kinds.groupBy("key").agg(F.max(F.struct("c", "root", "one")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", "main")
    return kinds.join(mixed, "key").where("root <> main.root").select(F.col("one").alias("u"), F.col("main.one").alias("v"))


def _left_over(shared: DataFrame, roots: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)``: links between members of one key that have different roots.

    Members outside a key's largest component look for partners among all its members; pairs are compared where they
    meet, so that only links leave a task.
    """

    def run(batches):
        def read(b):
            block, point, root, seeks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            hashes = np.empty(b.num_rows, dtype=object)
            hashes[:] = b.column(5).to_pylist()
            return [block, point, _matrix(b.column(2)), root, seeks, hashes]

        for cols in _whole_keys(batches, read):
            found = list(cross_links(*cols))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sizes = sets.select("point", F.octet_length("hashes").cast("long").alias("bytes"))
    labelled = _labelled(shared, roots).join(sizes, "point")
    kinds = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    kinds = kinds.groupBy("key").agg(F.max(F.struct("c", "root", "bytes")).alias("main"), F.sum("c").alias("members"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK_ROWS)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    outside = blocks(F.col("members") - F.col("main.c"), F.col("bytes") - F.col("main.bytes"))
    mixed = materialise(kinds.select("key", F.col("main.root").alias("main"), blocks(F.col("members"), F.col("bytes")).alias("mb"), outside.alias("ob")))
    # MinHashes and sets go along only here, with members of keys that hold several components
    rows = labelled.drop("bytes").join(mixed, "key").join(sigs, "point").join(sets, "point")
    # (o, m, seeks): the blocks that a member goes to, be it to be found or to seek; sets are joined once for both
    of = lambda n: F.pmod(F.xxhash64("point", n), n)
    place = lambda o, m, seeks: F.struct(o.cast("long").alias("o"), m.cast("long").alias("m"), F.lit(seeks).alias("seeks"))
    every = lambda n, at: F.transform(F.sequence(F.lit(0), F.col(n) - 1), at)
    found = every("ob", lambda o: place(o, of("mb"), False))
    seeks = every("mb", lambda m: place(of("ob"), m, True))
    both = rows.withColumn("at", F.explode(F.when(F.col("root") != F.col("main"), F.concat(found, seeks)).otherwise(found)))
    both = both.select(F.xxhash64("key", "at.o", "at.m").alias("block"), "point", "sig", "root", "at.seeks", "hashes")
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(run, "u long, v long")


def _roots(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(node, root)`` of the points that have near copies."""
    points = materialise(rows.dropDuplicates(["point"]).select("point", "fp", "bands", "sig"))
    sigs = points.select("point", "sig")
    posted = points.select("point", F.posexplode("bands").alias("band", "key")).select("key", "point", (F.col("band") < EARLY).alias("early"))
    met = materialise(_along_trees(posted))
    shared, pairs = met.where("key is not null").select("key", "point"), _alike_pairs(met.where("key is null").select("u", "v"), sigs)
    proposed = materialise(_simhash_pairs(points))
    of = shared.select("point").unionByName(proposed.select(F.explode(F.array("u", "v")).alias("point"))).distinct()
    wanted = materialise(rows.join(of, "point", "left_semi").groupBy("point").agg(F.min("t").alias("t")).select("t"))
    with _small_batches(docs.sparkSession):
        sets = materialise(_sets(docs, wanted))
        links = materialise(_links(materialise(pairs).unionByName(proposed), sets))
    roots = connected_components(links)
    for k in range(TRIES + 1):
        # what the trees have left apart: one of each component for all keys, then all members of keys still mixed
        roots = materialise(roots)
        left = materialise(_alike_pairs(_by_one_each(shared, roots, k), sigs)) if k < TRIES else None
        with _small_batches(docs.sparkSession):
            more = materialise(_links(left, sets) if k < TRIES else _left_over(shared, roots, sigs, sets).distinct())
        if not more.isEmpty():
            # the components found so far stand for the links that they came from
            roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return roots


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, t, component`` for each row: texts linked by similarities of 0.8 or more have one component.

    Texts without words are one component of their own.  Texts and sets are told apart by 64-bit hashes.
    """
    rows = materialise(prints(docs))
    roots = _roots(docs, rows)
    return rows.join(roots, rows.point == roots.node, "left").select("doc_id", "t", F.coalesce("root", "point").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of near copies; same columns.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more; the fingerprints' groups
    are a part of what proposes them.  Of a group the row of smallest doc_id stays (null ids are
    larger than any), of those the one of least text hash; of rows equal in both any one.  Null, empty and white texts
    are one group; an empty table gives no rows.
    """
    rows = materialise(components(docs))
    rows = rows.groupBy("component", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    best = rows.groupBy("component").agg(first.alias("best"), F.sum("n").alias("rows"))
    best = materialise(best.where("rows > 1"))
    twice = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("t") == F.col("best.t"))
    # rows of groups of one need no look: what is left are copies, which go unless they are the best of their group
    copies = materialise(rows.join(best.select("component", "best"), "component").withColumn("stays", twice).where("n > 1 OR NOT stays"))
    doc, text = free(docs, "_doc"), free(docs, "_text")
    keys = copies.select(F.col("doc_id").alias(doc), F.col("t").alias(text), "stays")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    kept = docs.join(small(keys.drop("stays")), same, "left_anti")
    again = keys.where("stays").drop("stays")
    if again.isEmpty():
        return kept
    hashed = docs.join(small(again), same).dropDuplicates([doc, text])
    return kept.unionByName(hashed.drop(doc, text))
