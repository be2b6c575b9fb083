"""Ranked lexical search over impact-ordered postings, score at a time.

A stated set of queries is run against all documents.  One pass over the texts writes each document's postings of the
queries' terms; sums over these give the corpus counts and so each posting's exact impact (the term's weight times its
saturated frequency, integers throughout).  Tasks then index some documents at a time: a term's postings are grouped by
exact impact, highest first.  For each query the groups of all its terms are added to the documents' sums in descending
order.  What the unread groups could still add bounds every document from above; reading stops only when at most a few
documents can still reach the k-th best score known, and the scores of those are completed from the documents' own
postings.  A task carries its k best from block to block, so later blocks mostly stop early; tasks' lists are merged in
two steps.  No posting is shuffled, and no list of a frequent term meets in one task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, materialise

TOP = 20
#: Distinct query texts that are searched at once, in bytes; more are searched in turns.
QUERY_BYTES = 8 << 20
#: Documents and postings that a task indexes at a time.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1_000_000
#: Documents whose scores may be left to complete when reading stops, as a multiple of k.
OPEN = 16
#: Each stretch of reading goes down to this share of the impact that the one before it ended with.
STEP = 0.75
#: Slices in which tasks' lists are merged first.
SLICES = 256
#: ASCII letters and digits and all other characters' bytes stay, A-Z in lower case; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of other than ASCII characters that are no letters or digits; none of null."""
    return (text or b"").translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    """A term's weight, of n documents with a term of which df hold this one."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Corpus:
    """Counts over all documents: how many have a term, how many terms there are, and each query term's weight."""

    def __init__(self, docs: int, length: int, held: np.ndarray):
        self.docs, self.length = docs, length
        self.weights = np.array([weight(docs, int(df)) for df in held], dtype=np.int64)

    def norm(self, n: int) -> int:
        return 100 - 25 + (25 * n * self.docs) // self.length


class Block:
    """Some documents' postings: by document, and by term in groups of equal impact, highest first."""

    def __init__(self, corpus: Corpus, lengths: list[int], found: list[np.ndarray], times: list[np.ndarray]):
        self.size = len(lengths)
        self.starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        self.term = np.concatenate(found).astype(np.int64)
        tf = np.concatenate(times).astype(np.int64)
        doc = np.repeat(np.arange(self.size), np.diff(self.starts))
        norm = np.array([corpus.norm(n) for n in lengths], dtype=np.int64)
        self.impact = corpus.weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]))
        order = np.lexsort((-self.impact, self.term))
        term, self.doc, self.sorted = self.term[order], doc[order], self.impact[order]
        fresh = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, dtype=bool)
        group = fresh | (np.r_[True, self.sorted[1:] != self.sorted[:-1]] if len(term) else fresh)
        #: Where groups of one term and impact begin, and what the impacts are, negated so that they ascend.
        self.group = np.append(np.flatnonzero(group), len(term))
        self.level = -self.sorted[self.group[:-1]]
        first = np.searchsorted(self.group, np.append(np.flatnonzero(fresh), len(term)))
        self.groups = {int(t): (a, b) for t, a, b in zip(term[fresh], first[:-1].tolist(), first[1:].tolist())}

    def search(self, query: list[tuple[int, int]], k: int, least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, the k best of at least ``least`` among them; ``query`` has terms with how often they
        occur, ``wanted`` is zeros over all terms."""
        lists = [[*self.groups[t], times] for t, times in query if t in self.groups]
        sums = np.zeros(self.size, dtype=np.int64)
        rest = [times * -int(self.level[a]) for a, b, times in lists]
        cut = max(rest, default=0)
        while True:
            bound = sum(rest)
            if self.size > k:
                least = max(least, int(np.partition(sums, self.size - k)[self.size - k]))
            able = np.flatnonzero(sums + bound >= max(least, 1))
            if len(able) <= OPEN * k or not bound:
                break
            cut = int(min(cut, max(rest)) * STEP)
            for j, (a, b, times) in enumerate(lists):
                if rest[j] > cut or (rest[j] and not cut):
                    # whole groups, down to the cut
                    to = b if not cut else a + int(np.searchsorted(self.level[a:b], -(cut // times), side="left"))
                    lo, hi = self.group[a], self.group[to]
                    sums[self.doc[lo:hi]] += times * self.sorted[lo:hi]
                    lists[j][0] = to
                    rest[j] = times * -int(self.level[to]) if to < b else 0
        if not bound:
            return able, sums[able]
        for t, times in query:
            wanted[t] = times
        spans = [slice(self.starts[d], self.starts[d + 1]) for d in able]
        scores = np.array([int(wanted[self.term[s]] @ self.impact[s]) for s in spans], dtype=np.int64)
        for t, _ in query:
            wanted[t] = 0
        ok = scores >= max(least, 1)
        return able[ok], scores[ok]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times`` for each row with a term: how many terms it has, and which of the vocabulary occur in
    it how often (as little-endian 32-bit integers)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, rows = part.column(0).to_pylist(), []
                for doc_id, text in zip(ids, part.column(1)):
                    if words := terms(text.as_py()):
                        held = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                        held = np.array(held, dtype="<u4").reshape(-1, 2)
                        rows.append((doc_id, len(words), held[:, 0].tobytes(), held[:, 1].tobytes()))
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, times binary")


def corpus(posted: DataFrame, size: int) -> Corpus:
    """The counts of a table of postings over ``size`` terms."""

    def run(batches):
        held, docs, length = np.zeros(size, dtype=np.int64), 0, 0
        for b in batches:
            docs, length = docs + b.num_rows, length + sum(b.column(1).to_pylist())
            for raw in b.column(2):
                held[np.frombuffer(raw.as_py(), "<u4")] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[docs, length, held[some]])], names=["term", "c"])

    # as many rows as the queries have terms
    counts = {r["term"]: r["c"] for r in posted.mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}
    return Corpus(counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(t, 0) for t in range(size)], dtype=np.int64))


def _best(posted: DataFrame, counts: Corpus, queries: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """``q, slice, doc_id, score``: each task's k best of each query."""

    def run(batches):
        best: list[list[tuple]] = [[] for _ in queries]
        wanted = np.zeros(len(counts.weights), dtype=np.int64)
        ids, lengths, found, times, held = [], [], [], [], 0

        def search():
            block = Block(counts, lengths, found, times)
            for q, query in enumerate(queries):
                # the lists are in order, so the last is the least that counts
                least = -best[q][-1][0] if len(best[q]) == k else 1
                docs, scores = block.search(query, k, least, wanted)
                if len(docs):
                    more = [(-s, ids[d] is not None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[q] = sorted(best[q] + more)[:k]
            for x in (ids, lengths, found, times):
                x.clear()

        for b in batches:
            for doc_id, n, t, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids.append(doc_id)
                lengths.append(n)
                found.append(np.frombuffer(t, "<u4"))
                times.append(np.frombuffer(c, "<u4"))
                held += len(found[-1])
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    search()
                    held = 0
        if ids:
            search()
        rows = [(q, doc_id if known else None, -s) for q, found_ in enumerate(best) for s, known, doc_id in found_]
        cols = list(zip(*rows)) or [(), (), ()]
        at = TaskContext.get().partitionId() % SLICES
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([at] * len(rows), pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["q", "slice", "doc_id", "score"])

    return posted.mapInArrow(run, "q int, slice int, doc_id long, score long")


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """``q, rank, doc_id, score`` for each text."""
    found = [Counter(terms(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for f in found for t in f}))}
    posted = materialise(postings(docs, vocabulary))
    counts = corpus(posted, len(vocabulary))
    queries = [[(vocabulary[t], times) for t, times in f.items()] for f in found]
    merged = _ranked(_best(posted, counts, queries, k), ["q", "slice"], k).drop("rank")
    return _ranked(merged, ["q"], k).select("q", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0.

    A null or empty item, or one of which no document holds a term, has no rows, nor has a null or empty document any;
    items that repeat each get their rows; documents that repeat are ranked one by one.  Equal scores ascend by doc_id,
    a null one first.  Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    key = free(items, "_query")
    asked = items.withColumn(key, F.col("text").cast("string")).select(F.col("item_id"), F.col(key))
    texts = materialise(asked.select(key).where(F.col(key).isNotNull()).distinct())
    size = texts.agg(F.sum(F.octet_length(key) + 16)).first()[0] or 0
    turns = -(-size // QUERY_BYTES)
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    for turn in range(turns):
        # about QUERY_BYTES
        part = [r[0] for r in texts.where(F.pmod(F.xxhash64(key), F.lit(turns)) == turn).collect()]
        if part:
            number = F.broadcast(spark.createDataFrame(list(enumerate(part)), f"q int, {key} string"))
            ranked = _search(docs, [t.encode() for t in part], k)
            rows = asked.join(number, key).join(ranked, "q").select("item_id", "rank", "doc_id", "score")
            out = out.unionByName(rows) if turn else rows
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
m AS (SELECT rid, doc_id, 75 + (25 * len(t) * n) // l AS m FROM d, c WHERE len(t) > 0),
a AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
s AS (SELECT qid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM a JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
