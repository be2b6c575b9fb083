"""Exact substring removal: every byte covered by a string of LENGTH bytes that also starts elsewhere goes.

Most starts are settled before any suffix is sorted, and without missing one:

* Equal whole texts are counted first; one of them goes on.
* Each start's LENGTH bytes have an anchor, the least hash among their GRAM-byte strings (the last of equal ones), so
  equal strings have equal anchors at equal offsets.  Successive starts with one anchor form a run.  Runs whose whole
  extents are equal are repeats throughout.
* Any string whose anchor lies ``lo <= d < hi`` bytes in covers the bytes from ``anchor - lo`` to ``anchor - hi + 1 +
  LENGTH``.  A run's starts are cut into STEPS such ranges; a range that shares those bytes with no other run of the
  anchor holds no repeat.

What is left, the bytes around changes between near copies and around passages that documents share, goes to suffix
arrays (``suffixes``), many contexts to one array: equal strings of LENGTH bytes are neighbours in it.  The bytes that
a sharing range has in common stand in the array as one symbol, so only what lies around them is sorted byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffixes import suffix_array

LENGTH = 400
GRAM = 16
STEPS = 4
#: Contexts of one sharing group beyond which their starts are compared by counting them in Spark instead.
GROUP_CONTEXTS = 2_000
#: Symbols that one suffix array is built over, unless one group has more.
ARRAY_SYMBOLS = 1 << 18
#: Symbols that a task sorts, about, in arrays of ARRAY_SYMBOLS.
TASK_SYMBOLS = 1 << 21
#: Bytes up to which a table is broadcast, counting so many for a row, or for an element of its rows' lists.
BROADCAST_BYTES, ROW_BYTES = 24 << 20, 48
#: Runs of one anchor that are held before they are thinned to one of each variant.
HELD_RUNS = 50_000
PIECE = 1 << 20  # starts of a long text that are searched at once

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 17)
        up, down = np.full(m, _C), np.full(m, np.uint64(pow(int(_C), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


class Hashed:
    """64-bit hashes of any stretch (of eight bytes at least) of a text."""

    def __init__(self, text: np.ndarray):
        y = text.astype(np.uint64)
        y = y[:-1] | (y[1:] << np.uint64(8))
        y = y[:-2] | (y[2:] << np.uint64(16))
        self.eights = _mix(y[:-4] | (y[4:] << np.uint64(32)))
        up, self.down = _pow(len(self.eights))
        self.sums = np.r_[np.uint64(0), np.cumsum(self.eights * up[: len(self.eights)], dtype=np.uint64)]

    def grams(self) -> np.ndarray:
        """Hashes of all stretches of GRAM bytes."""
        k = GRAM - 8
        return _mix(self.eights[:-k] * _A + self.eights[k:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end - 7] - self.sums[start]) * self.down[start])


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n successive elements, by doubling."""
    out, have = x, 1
    while 2 * have <= n:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def runs(text: bytes):
    """Columns (anchor hash, anchor's place, first start, last start, extent's hash, STEPS range keys; 0: no start)."""
    out = []
    for base in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
        raw = np.frombuffer(text, np.uint8)[base : base + PIECE + LENGTH - 1]
        h = Hashed(raw)
        grams = h.grams()
        low = np.uint64((1 << 21) - 1)
        place = np.arange(len(grams), dtype=np.uint64)
        best = _window_min((grams & ~low) | (low - place), LENGTH - GRAM + 1)
        anchor = (low - (best & low)).astype(np.int64)  # of each start
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        c = anchor[first]
        keys = []
        for q in range(STEPS):
            lo, hi = _bounds(q)
            has = (c - last < hi) & (c - first >= lo)
            key = np.zeros(len(c), np.uint64)
            key[has] = h.stretch(c[has] - lo, c[has] - hi + 1 + LENGTH) | np.uint64(1)
            keys.append(key)
        out.append((grams[c], c + base, first + base, last + base, h.stretch(first, last + LENGTH), *keys))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.uint64)] * (5 + STEPS)


def _bounds(q: int) -> tuple[int, int]:
    """Range q of a start's distance to its anchor: lo <= anchor - start < hi."""
    width = -(-(LENGTH - GRAM + 1) // STEPS)
    return q * width, min((q + 1) * width, LENGTH - GRAM + 1)


def _combined(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = _mix(out * _C + p.astype(np.uint64) + _B)
    return out


def _counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, first, at, n = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    return first, at, n


def _judge(anchor, c, first, last, extent, keys, weight):
    """Of the complete runs of some anchors: which repeat throughout; and of the others, with what they may share bytes
    with: (row, group, first start, last start, weight, where the shared bytes start, starts that a full range has) of
    each range to be compared."""
    variant = _combined(anchor, c - first, last - first, extent)
    head, at, n = _counts(variant)
    times = np.bincount(at, weight).astype(np.int64)
    whole = times[at] >= 2
    rows, groups, a, b, core, width = [], [], [], [], [], []
    one = head  # a row of each variant
    many = times >= 2
    for q in range(STEPS):
        has = np.flatnonzero(keys[q][one])
        group = _combined(anchor[one][has], np.full(len(has), q + 1, np.uint64), keys[q][one][has])
        _, gat, gn = _counts(group)
        open_ = np.bincount(gat, ~many[has]) > 0
        ok = (gn >= 2)[gat] & open_[gat]
        r = one[has[ok]]
        lo, hi = _bounds(q)
        rows.append(r)
        groups.append(group[ok])
        a.append(np.maximum(first[r], c[r] - hi + 1))
        b.append(np.minimum(last[r], c[r] - lo))
        core.append(c[r] - lo)
        width.append(np.full(len(r), hi - lo))
    rows, groups, a, b, core, width = (np.concatenate(x) for x in (rows, groups, a, b, core, width))
    return whole, rows, groups.view(np.int64), a, b, np.where(whole[rows], 2, 1), core, width


RUN = "anchor long, doc_id long, th long, weight int, c long, first long, last long, extent long, " + ", ".join(f"k{q} long" for q in range(STEPS))
ASK = "doc_id long, th long, grp long, a long, b long, weight int, core long, width int"


def _table(schema: str, *cols) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")])
    kind = {"long": pa.int64(), "int": pa.int32()}
    arrays = [x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x) for x in cols]
    return pa.RecordBatch.from_arrays([x if x.type == kind[k] else x.cast(kind[k]) for x, k in zip(arrays, kinds)], names=list(names))


def _emit_runs(batches):
    """doc_id, text, th, weight -> runs."""
    for b in batches:
        ids, ths, weights = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
        held, meta, n = [], [], 0
        for i, t in enumerate(b.column(1)):
            cols = runs(t.as_buffer().to_pybytes() if t.is_valid else b"")
            if len(cols[0]):
                held.append(cols)
                meta.append((i, len(cols[0])))
                n += len(cols[0])
            if n > 50_000 or (n and i == len(ids) - 1):
                yield _run_batch(held, meta, ids, ths, weights)
                held, meta, n = [], [], 0
        if n:
            yield _run_batch(held, meta, ids, ths, weights)


def _run_batch(held, meta, ids, ths, weights):
    """Runs that are equal here are combined before the shuffle: one goes on with weight 2, the others are settled as
    repeats (no place; dealt by a hash of their own, as an anchor may be that of very many runs)."""
    cols = [np.concatenate(x) for x in zip(*held)]
    of = np.repeat([i for i, _ in meta], [k for _, k in meta])
    weight = np.array(weights)[of]
    anchor, c, first, last, extent = cols[:5]
    head, at, _ = _counts(_combined(anchor, c - first, last - first, extent))
    weight[head] = np.minimum(np.bincount(at, weight), 2)
    extra = np.ones(len(of), bool)
    extra[head] = False
    cols[0] = np.where(extra, _combined(of, first), anchor)
    cols[1] = np.where(extra, -1, c)
    take = lambda v, kind: pa.array(v, kind).take(pa.array(of))
    return _table(RUN, cols[0], take(ids, pa.int64()), take(ths, pa.int64()), weight, *cols[1:])


def _classify(batches):
    """Runs sorted by anchor -> repeats (grp null) and ranges to be compared.

    A complete anchor's runs are judged together.  Of a very frequent anchor one row of each variant is held: rows of a
    variant met again are repeats, and go out at once.
    """
    held: list[pa.Table] = []
    rows, limit = 0, HELD_RUNS
    for b in batches:
        t = pa.Table.from_batches([b])
        settled = t.column("c").to_numpy() < 0
        if settled.any():
            yield _repeats(t, np.flatnonzero(settled))
            t = t.take(pa.array(np.flatnonzero(~settled)))
        if not t.num_rows:
            continue
        anchors = t.column("anchor").to_numpy()
        if held and held[0].column("anchor")[0].as_py() == anchors[-1]:
            held.append(t)
            rows += t.num_rows
        else:
            cut = int(np.searchsorted(anchors, anchors[-1]))
            done = [*held, t.slice(0, cut)]
            if sum(x.num_rows for x in done):
                yield from _judged(pa.concat_tables(done).combine_chunks())
            held, rows, limit = [t.slice(cut)], t.num_rows - cut, HELD_RUNS
        if rows > limit:
            kept, out = _thinned(pa.concat_tables(held).combine_chunks())
            yield from out
            held, rows = [kept], kept.num_rows
            limit = max(HELD_RUNS, 2 * rows)
    if held:
        yield from _judged(pa.concat_tables(held).combine_chunks())


def _columns(t):
    cols = {k: t.column(k).to_numpy() for k in t.column_names if k not in ("doc_id", "th")}
    u = lambda k: cols[k].view(np.uint64)
    return u("anchor"), cols["c"], cols["first"], cols["last"], u("extent"), [u(f"k{q}") for q in range(STEPS)], cols["weight"]


def _repeats(t, rows):
    s = t.take(pa.array(rows)).combine_chunks()
    one = lambda k: s.column(k).combine_chunks() if s.num_rows else pa.array([], pa.int64())
    return _table(ASK, one("doc_id"), one("th"), pa.nulls(len(rows), pa.int64()), one("first"), one("last"), np.full(len(rows), 2), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32()))


def _judged(t):
    whole, rows, *ask = _judge(*_columns(t))
    if whole.any():
        yield _repeats(t, np.flatnonzero(whole))
    if len(rows):
        s = t.take(pa.array(rows)).combine_chunks()
        yield _table(ASK, s.column("doc_id").combine_chunks(), s.column("th").combine_chunks(), *ask)


def _thinned(t):
    anchor, c, first, last, extent, _, weight = _columns(t)
    head, at, _ = _counts(_combined(anchor, c - first, last - first, extent))
    times = np.minimum(np.bincount(at, weight), 2).astype(np.int32)
    extra = np.setdiff1d(np.arange(t.num_rows), head)
    kept = t.take(pa.array(head)).combine_chunks()
    kept = kept.set_column(kept.column_names.index("weight"), "weight", pa.array(times))
    return kept, [_repeats(t, extra)] if len(extra) else []


CONTEXT = "doc_id long, th long, grp long, a long, weight int, width int, left binary, digest binary, right binary"


def _contexts(batches):
    """doc_id, th, text, asks -> what each range to be compared has before its shared bytes, their digest, what it has
    after them."""
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] * 3
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for b in batches:
        rows = []
        for doc, th, text, asks in zip(*(b.column(i) for i in range(4))):
            raw = text.as_py()
            doc, th = doc.as_py(), th.as_py()
            for x in asks.as_py():
                core, end = x["core"], x["core"] + LENGTH - x["width"] + 1
                digest = hashlib.blake2b(raw[core:end], digest_size=16).digest()
                rows.append((doc, th, x["grp"], x["a"], x["weight"], x["width"], raw[x["a"] : core], digest, raw[end : x["b"] + LENGTH]))
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def repeated_starts(contexts: list[tuple[int, bytes, bytes, bytes]], weights: list[int]) -> list[list[int]]:
    """For each context (width, left, digest, right), the starts in it whose LENGTH bytes occur at another start of any
    context, or in one of weight 2: neighbours in the suffix array of all contexts, a mark between each.

    A start's LENGTH bytes are ``width`` symbols: bytes before the shared ones, these, bytes after them.
    """
    cores: dict[bytes, int] = {}
    parts = []
    for _, left, digest, right in contexts:
        core = 257 + cores.setdefault(digest, len(cores))
        parts += [np.frombuffer(left, np.uint8), np.array([core]), np.frombuffer(right, np.uint8), np.array([256])]
    text = np.concatenate(parts)
    lengths = np.array([len(left) + 1 + len(right) for _, left, _, right in contexts])
    widths = np.array([w for w, *_ in contexts])
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    inside = np.arange(len(text)) - (np.cumsum(lengths + 1) - lengths - 1)[owner]
    whole = inside + widths[owner] <= lengths[owner]
    order = np.array(suffix_array(text))
    order = order[whole[order]]
    raw = text.astype("<u4").tobytes()
    found: list[list[int]] = [[] for _ in contexts]
    same: list[int] = []
    last = None
    owners, places = owner[order].tolist(), inside[order].tolist()
    ends = (order + widths[owner[order]]).tolist()
    order = order.tolist()
    for i in range(len(order) + 1):
        window = raw[4 * order[i] : 4 * ends[i]] if i < len(order) else None
        if window is not None and window == last:
            same.append(i)
            continue
        if len(same) > 1 or (same and weights[owners[same[0]]] > 1):
            for k in same:
                found[owners[k]].append(places[k])
        same, last = [i], window
    return found


def _intervals(starts):
    starts = np.sort(np.array(starts, dtype=np.int64))
    first = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
    return starts[first], starts[np.r_[first[1:], len(starts)] - 1]


MARK = "_doc long, _th long, starts array<struct<a: long, b: long>>"
FOUND = "doc_id long, th long, a long, b long"


def _sorted_suffixes(batches):
    """Contexts sorted by group -> intervals of repeated starts; whole groups go to an array, as many as fit.

    Equal contexts of a group are repeats throughout.  One of them goes on, if the group has any that differs.
    """
    held, size = [], 0

    def settle(rows):
        found: list = [None] * len(rows)
        groups: dict[int, dict[tuple, list[int]]] = {}
        for i, r in enumerate(rows):
            groups.setdefault(r[2], {}).setdefault(r[5:], []).append(i)
        left = []
        for variants in groups.values():
            single = False
            for (width, before, _, after), at in variants.items():
                if len(at) > 1:
                    for i in at:
                        found[i] = range(len(before) + len(after) + 2 - width)
                single |= len(at) == 1 and rows[at[0]][4] < 2
            if single and len(variants) > 1:
                left += [(at[0], max(len(at), rows[at[0]][4])) for at in variants.values()]
        if left:
            starts = repeated_starts([rows[i][5:] for i, _ in left], [w for _, w in left])
            for (i, w), x in zip(left, starts):
                if w < 2:
                    found[i] = x
        cols = ([], [], [], [])
        for r, starts in zip(rows, found):
            if starts and r[4] < 2:
                for a, b in zip(*_intervals(starts)):
                    for col, v in zip(cols, (r[0], r[1], r[3] + int(a), r[3] + int(b))):
                        col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "th", "a", "b"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and size > ARRAY_SYMBOLS and row[2] != held[-1][2]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6]) + len(row[8]) + 2
    if held:
        yield settle(held)


def _started(batches):
    """Contexts of oversized groups -> each start with its string's digest."""
    for b in batches:
        for doc, th, _, a, weight, width, left, digest, right in zip(*(c.to_pylist() for c in b.columns)):
            n = len(left) + 1 + len(right) - width + 1
            of = [hashlib.blake2b(left[i:] + digest + right[: width - 1 - len(left) + i], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(range(a, a + n), pa.int64()), pa.array([weight] * n, pa.int32()), pa.array(of, pa.binary())],
                names=["doc_id", "th", "a", "weight", "digest"],
            )


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """For a broadcast if it has few rows, or few elements in the arrays of ``lists``."""
    n = df.count() if lists is None else df.agg(F.sum(F.size(lists))).first()[0] or 0
    return F.broadcast(df) if n * ROW_BYTES <= BROADCAST_BYTES else df


def _joined(batches):
    """Intervals of starts whose strings touch become one."""
    for b in batches:
        lists = []
        for x in b.column(2):
            out: list[list[int]] = []
            for start, last in sorted((s["a"], s["b"]) for s in x.as_py()):
                if out and start <= out[-1][1] + LENGTH:
                    out[-1][1] = max(out[-1][1], last)
                else:
                    out.append([start, last])
            lists.append([{"a": a, "b": z} for a, z in out])
        yield b.set_column(2, b.schema.field(2), pa.array(lists, b.schema.field(2).type))


def _same(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right["_doc"]) & (left.th == right["_th"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text")).withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit("copy"), "text")})


def repeated_intervals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, intervals): texts (by two 64-bit hashes) that several rows have, ``rows`` many; and for the others ``doc_id, th, a, b``,
    the starts a to b being repeated."""
    texts = _keyed(docs)
    copies = materialise(
        texts.where(F.octet_length("text") >= LENGTH).groupBy(F.col("th").alias("_th"), F.col("th2").alias("_th2")).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least")).where("rows > 1")
    )
    one = texts.where(F.octet_length("text") >= LENGTH).join(_small(copies), (F.col("th") == F.col("_th")) & (F.col("th2") == F.col("_th2")), "left").where("rows IS NULL OR doc_id <=> least")
    found = (
        one.select("doc_id", "text", "th", F.when(F.col("rows") > 1, 2).otherwise(1).alias("weight"))
        .mapInArrow(_emit_runs, RUN)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_classify, ASK)
    )
    found = materialise(found)
    settled, asks = found.where("grp IS NULL").select("doc_id", "th", "a", "b"), found.where("grp IS NOT NULL")
    wanted = materialise(asks.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("grp", "a", "b", "weight", "core", "width")).alias("asks")))
    source = one.select("doc_id", "th", "text")
    contexts = source.join(_small(wanted, "asks"), _same(source, wanted)).select("doc_id", "th", "text", "asks").mapInArrow(_contexts, CONTEXT)
    # sorting takes long for few bytes, so tasks are dealt by symbols and not by what is shuffled
    symbols = asks.agg(F.sum(F.col("b") - F.col("a") + F.col("width"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-symbols // TASK_SYMBOLS))
    large = materialise(asks.groupBy(F.col("grp").alias("_grp")).count().where(F.col("count") > GROUP_CONTEXTS).select("_grp"))
    if large.isEmpty():
        sorted_ = contexts.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(_sorted_suffixes, FOUND)
        return copies, materialise(settled.unionByName(sorted_))
    small = contexts.join(_small(large), contexts.grp == large["_grp"], "left_anti")
    sorted_ = small.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(_sorted_suffixes, FOUND)
    starts = contexts.join(_small(large), contexts.grp == large["_grp"], "left_semi").mapInArrow(_started, "doc_id long, th long, a long, weight int, digest binary")
    starts = materialise(starts)
    twice = starts.groupBy(F.col("digest").alias("_digest")).agg(F.sum("weight").alias("n")).where("n > 1").select("_digest")
    counted = starts.join(twice, starts.digest == twice["_digest"], "left_semi").select("doc_id", "th", "a", F.col("a").alias("b"))
    return copies, materialise(settled.unionByName(sorted_).unionByName(counted))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text`` (its bytes; none if null), ``spans`` (the maximal removed stretches, ascending, end exclusive)
    and ``kept`` (the remaining bytes).

    Texts under LENGTH bytes stay whole; of equal texts all are removed, repeated rows too; an empty table gives no
    rows; other columns are not read.  Kept bytes need not be valid UTF-8, as a stretch may begin or end inside a
    character.
    """
    copies, intervals = repeated_intervals(docs)
    texts = _keyed(docs)
    marks = materialise(intervals.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("a", "b")).alias("starts")).mapInArrow(_joined, MARK))
    copied = copies.select(F.col("_th").alias("_copy"), F.col("_th2").alias("_copy2"), F.lit(True).alias("whole"))
    n = F.octet_length("text")
    rows = texts.join(_small(marks, "starts"), _same(texts, marks), "left").join(_small(copied), (F.col("th") == F.col("_copy")) & (F.col("th2") == F.col("_copy2")) & (n >= LENGTH), "left")
    stretch = lambda start, end: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
    spans = (
        F.when(F.col("whole"), F.array(stretch(F.lit(0), n)))
        .when(F.col("starts").isNotNull(), F.transform("starts", lambda s: stretch(s["a"], s["b"] + LENGTH)))
        .otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
    )
    rows = rows.select("doc_id", "text", spans.alias("spans"))
    return rows.select("*", F.when(F.size("spans") == 0, F.col("text")).otherwise(_between()).alias("kept"))


def _between():
    """The bytes of ``text`` before, between and after its ``spans``; joined as strings, which takes bytes as they are."""
    count = F.size("spans")

    def piece(i):
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"]).cast("int")
        end = F.when(i == count, F.octet_length("text")).otherwise(F.get("spans", i)["start"]).cast("int")
        return F.substring("text", start + 1, end - start).cast("string")

    return F.array_join(F.transform(F.sequence(F.lit(0), count), piece), "").cast("binary")


def digest(rows: DataFrame) -> DataFrame:
    """Of ``without_repeats``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and ``text``, what is left as a string, in which
    a character that was cut in two shows as U+FFFD."""
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    return digest(without_repeats(docs))
