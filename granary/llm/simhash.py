"""SimHash near-duplicate grouping with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zero bits).  The (23, 12) Golay
code is perfect: every 23-bit word lies within three bits of exactly one codeword, whose 12-bit message is its index.
Of three segments with three wrong bits at most, two have at most one wrong bit each (the segments' errors sorted are
0 0 x or 0 1 x or 1 1 1).  If two words differ in one bit at most, the codeword nearest to the first is the codeword
nearest to the second or to one of its one-bit neighbours, so that the second's *nearby* set (one to six indices)
holds the first's index.  Each fingerprint therefore posts its own index pair under three keys, and its nearby pairs
under about 28 keys for each of the three segment pairs; every pair within three bits meets under a common key, and
what meets is verified on the 64 bits.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

SEED = 42
#: Bits of the three segments, from the low end.
WIDTHS = (23, 23, 18)
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Most members of one key that one task searches at once; larger keys are cut into blocks, and all pairs of blocks
#: are searched, each by a task of its own.
GROUP_ROWS = 100_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 50_000  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the lower-cased word shingles of a UTF-8 text; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return 0
    width = min(width, len(parts))
    joined = b" ".join(parts)
    ends = list(accumulate(len(w) + 1 for w in parts))
    starts = [0, *ends[:-1]]
    n = len(parts) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        h = np.fromiter(
            [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at:stop], ends[at + width - 1 : stop + width - 1])],
            dtype="<u8",
            count=stop - at,
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row of documents; fp is the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Nearest-codeword indices, vectorised by syndrome decoding; both tables follow from the generator."""

    def __init__(self):
        message = np.arange(4096, dtype=np.int64)
        rest = message << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        self.parity = rest
        one = 1 << np.arange(23, dtype=np.int64)
        a, b, c = np.meshgrid(one, one, one, indexing="ij")
        # repeats make patterns of weight one and two as well: x | x | y
        errors = np.unique(np.concatenate([[0], (a | b | c).ravel()]))
        self.leader = np.zeros(2048, dtype=np.int64)
        self.leader[self.parity[errors >> 11] ^ (errors & 2047)] = errors

    def index(self, word: np.ndarray) -> np.ndarray:
        return (word ^ self.leader[self.parity[word >> 11] ^ (word & 2047)]) >> 11

    def nearby(self, word: np.ndarray, width: int) -> np.ndarray:
        """Six columns: the distinct indices of each word and of its one-bit neighbours; -1 where there are fewer."""
        around = np.concatenate([np.zeros(1, dtype=np.int64), 1 << np.arange(width, dtype=np.int64)])
        found = np.sort(self.index(word[:, None] ^ around[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return -np.sort(-found, axis=1)[:, :6]


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, own): every key under which each fingerprint is posted; own marks its nearest index pair."""
    words, shift = [], 0
    for w in WIDTHS:
        words.append((fps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << w) - 1))
        shift += w
    own = [golay.index(x) for x in words]
    near = [golay.nearby(x, w) for x, w in zip(words, WIDTHS)]
    keys, rows, owns = [], [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = near[i][:, :, None], near[j][:, None, :]
        ok = ((a >= 0) & (b >= 0)).reshape(-1)
        key = ((p << 24) | (a << 12) | b).reshape(-1)[ok]
        row = np.repeat(np.arange(len(fps)), 36)[ok]
        keys.append(key)
        rows.append(row)
        owns.append(key == ((p << 24) | (own[i] << 12) | own[j])[row])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(owns)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _flood(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large key's members: each member is reached once, from one that was reached before."""
    left, a, b = fps, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            head, front = front[:64], front[64:]
            close = np.bitwise_count(head[:, None] ^ left[None, :]) <= distance
            hit = close.any(axis=0)
            if hit.any():
                a.append(head[close[:, hit].argmax(axis=0)])
                b.append(left[hit])
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def link_groups(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of equal keys (rows sorted by key, own rows first), as far as connectivity needs them."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    owns = np.add.reduceat(own.astype(np.int64), first)
    ok = (owns > 0) & (size > 1)
    first, size, owns = first[ok], size[ok], owns[ok]
    u = fp.view(np.uint64)
    a, b = [u[:0]], [u[:0]]
    large = size > 64
    for s, n in zip(first[large], size[large]):
        x, y = _flood(np.unique(u[s : s + n]), distance)
        a.append(x)
        b.append(y)
    first, size, owns = first[~large], size[~large], owns[~large]
    for at in range(0, len(first), 2000):
        f, n, o = (v[at : at + 2000] for v in (first, size, owns))
        pairs = n * o
        k, base = _spread(pairs), np.repeat(f, pairs)
        x, y = u[base + k // np.repeat(n, pairs)], u[base + k % np.repeat(n, pairs)]
        hit = (x != y) & (np.bitwise_count(x ^ y) <= distance)
        a.append(x[hit])
        b.append(y[hit])
    return _contract(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connectivity with one link for each member at most: (member, smallest member of its component)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


LINK = "u long, v long, key long, own boolean"


def _searched(posted: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) found under each key; the rows of keys with over GROUP_ROWS members come back unsearched (key set).

    Rows of one key arrive together and sorted, batch by batch; only the last, unfinished key is carried on.
    """

    def run(batches):
        def out(u, v, key=None, own=None):
            none = lambda kind: pa.nulls(len(u), kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(u), pa.array(v) if v is not None else none(pa.int64()), none(pa.int64()) if key is None else pa.array(key), none(pa.bool_()) if own is None else pa.array(own)],
                names=["u", "v", "key", "own"],
            )

        held, passing = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if passing is not None:
                on = cols[0] == passing
                if on.any():
                    yield out(cols[1][on], None, cols[0][on], cols[2][on])
                if on.all():
                    continue
                cols, passing = [c[~on] for c in cols], None
            held = [np.concatenate(x) for x in zip(held, cols)]
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if cut:
                u, v = link_groups(*(x[:cut] for x in held), distance)
                if len(u):
                    yield out(u, v)
                held = [x[cut:] for x in held]
            if len(held[0]) > GROUP_ROWS:
                passing = held[0][0]
                yield out(held[1], None, held[0], held[2])
                held = [x[:0] for x in held]
        if len(held[0]):
            u, v = link_groups(*held, distance)
            if len(u):
                yield out(u, v)

    rows = posted.repartition("key").sortWithinPartitions("key", F.col("own").desc())
    return rows.select("key", "fp", "own").mapInArrow(run, LINK)


def hamming_links(points: DataFrame, distance: int = 3) -> DataFrame:
    """``(u, v)``: links that connect the distinct longs ``fp`` as all pairs within ``distance`` (3 at most) bits do."""

    def post(batches):
        golay = Golay()
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                key, row, own = golay_keys(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(own)], names=["key", "fp", "own"])

    # few bytes here become many: a number of tasks is asked for, so that they aren't drawn together by size
    spread = points.select("fp").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    found = materialise(_searched(spread.mapInArrow(post, "key long, fp long, own boolean"), distance))
    links, rest = found.where("v is not null").select("u", "v"), found.where("v is null")
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS // 2)).cast("int").alias("blocks"))
    if not rest.isEmpty():
        mine = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
        blocks = (
            rest.join(sizes, "key")
            .withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), F.col("u").alias("fp"), F.lit(True).alias("own"))
        )
        links = links.unionByName(_in_blocks(blocks, distance))
    return links


def _in_blocks(blocks: DataFrame, distance: int) -> DataFrame:
    """Links of each pair of blocks of an oversized key; a pair has about GROUP_ROWS members."""

    def run(key, group):
        fps = np.unique(group.column("fp").to_numpy().view(np.uint64))
        a, b = _flood(fps, distance)
        return pa.table({"u": a.view(np.int64), "v": b.view(np.int64)})

    return blocks.groupBy("key").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable.  A text
    that is null, empty or white space has fingerprint zero and links like any other; equal texts and repeated rows
    have one fingerprint; an empty table gives no rows; other columns are not read; rows whose doc_id is null are
    returned, with the smallest doc_id of their group (null if it has none).
    """
    prints = materialise(fingerprints(docs, width))
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(hamming_links(points, distance))
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written tables, so that adaptive execution can split a frequent root or fingerprint over tasks
    named = materialise(named)
    lowest = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")))
    groups = materialise(named.join(lowest, "root").select("fp", "component_id"))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
