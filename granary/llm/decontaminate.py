"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (powers of two of their distinct shingles), and every item of a partition keeps the same
number k of minimum hashes (a bottom-k MinHash), k = 2 m + 1 where m is the most shingles that an item of the
partition may miss, or all hashes if it has fewer.  An item of n shingles that a document contains at threshold t misses
floor((1 - t) n) of them at most, so at least k - floor((1 - t) n) of its kept hashes are among the document's, however
long that is.  Pairs that reach this bound are the candidates: none is missed, and only they are compared by their
shingles.

An item of fewer words than a shingle is one shingle of its own length, looked up among the document's windows of that
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, free, materialise, words

WIDTH = 5
THRESHOLD = 0.8
#: Tables are broadcast up to so many bytes of their columns and joined by shuffles beyond that.
BROADCAST_BYTES = 32 << 20


def shingles(words_: Column, width: int) -> Column:
    """Word windows of ``width`` as strings, repeats included; none if there are fewer words."""
    at = lambda k: F.slice(words_, F.lit(k + 1), F.greatest(F.size(words_) - (width - 1), F.lit(0)))
    return F.transform(F.arrays_zip(*[at(k).alias(f"w{k}") for k in range(width)]), lambda s: F.concat_ws(" ", *[s[f"w{k}"] for k in range(width)]))


def _hashed(hashes: Column, width: int) -> Column:
    """Hashes of the word windows, from the words' hashes."""
    first = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return F.transform(first, lambda h, i: F.xxhash64(F.lit(width), h, *[F.get(hashes, i + k) for k in range(1, width)]))


def _windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """Adds ``_h``, the distinct hashes of the windows of all widths, to a table with texts."""
    hashes = F.transform(words(F.lower("text")), lambda w: F.xxhash64(w))
    every = df.withColumn("_wh", hashes)
    found = [_hashed(F.col("_wh"), w) for w in widths]
    return every.withColumn("_h", F.array_distinct(F.concat(*found) if found else F.expr("CAST(array() AS array<bigint>)"))).drop("_wh")


def _small(df: DataFrame, bytes_: Column) -> DataFrame:
    return F.broadcast(df) if (df.agg(F.sum(bytes_)).first()[0] or 0) <= BROADCAST_BYTES else df


def item_shingles(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, width, s, h, n``: each item's distinct shingles, their hashes and their number; none without words."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.lower(F.col("text").cast("string"))).alias("_w")).where("size(_w) > 0")
    texts = texts.withColumn("width", F.least(F.size("_w"), F.lit(width)))
    one = F.array(F.concat_ws(" ", "_w"))
    rows = texts.select("item_id", "width", F.explode(F.when(F.col("width") < width, one).otherwise(F.array_distinct(shingles(F.col("_w"), width)))).alias("s")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    # hashed as ``_hashed`` does
    parts = F.transform(F.split("s", " "), lambda w: F.xxhash64(w))
    h = F.lit(None).cast("long")
    for k in range(1, width + 1):
        h = F.when(F.col("width") == k, F.xxhash64(F.lit(k), *[F.get(parts, F.lit(i)) for i in range(k)])).otherwise(h)
    return rows.join(sizes, "item_id").withColumn("h", h)


def sketch(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``partition, item_id, h, need``: the minimum hashes kept of each item, and how many of them a document that
    contains the item has at least."""
    missing = lambda n: F.floor(F.round(F.lit(1 - threshold) * n, 9))
    partition = F.floor(F.log2(F.col("n")))
    most = F.pow(F.lit(2.0), F.col("partition") + 1) - 1  # shingles of the partition's items
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("h", "s"))
    rows = items.withColumn("partition", partition).withColumn("k", F.least(2 * missing(most) + 1, F.col("n"))).withColumn("rank", rank)
    return rows.where("rank <= k").select("partition", "item_id", "h", (F.col("k") - missing(F.col("n"))).alias("need"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment``: every item contained in a document at the threshold.

    Containment is the share of an item's distinct shingles that occur in the document.  Null and empty texts contain
    nothing, items without a word are contained nowhere; repeated rows of a doc_id count as one document; a null doc_id
    or item_id is never reported; extra columns are not read; empty tables give no rows.
    """
    items = materialise(item_shingles(benchmark.where("item_id is not null"), width))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # ``width`` values at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    kept = materialise(sketch(items, threshold))
    # outer: for a plain explode Spark infers a filter that computes the windows again
    hits = _windows(texts, widths).select("doc_id", F.explode_outer("_h").alias("h")).join(_small(kept, F.lit(32)), "h").select("doc_id", "item_id", "need", "h").distinct()
    pairs = materialise(hits.groupBy("doc_id", "item_id", "need").agg(F.count(F.lit(1)).alias("hits")).where("hits >= need").select("doc_id", "item_id"))
    likely = texts.join(_small(pairs.select("doc_id").distinct(), F.lit(8)), "doc_id", "left_semi").withColumn("_w", words(F.lower("text")))
    every = F.concat(*[shingles(F.col("_w"), w) for w in widths]) if widths else F.expr("CAST(array() AS array<string>)")
    exact = likely.select("doc_id", F.explode_outer(F.array_distinct(every)).alias("s"))
    shared = exact.join(_small(items.select("s", "item_id", "n"), F.octet_length("s") + 16), "s").select("doc_id", "item_id", "n", "s").distinct()
    return (
        shared.join(_small(pairs, F.lit(16)), ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id", "n")
        .agg(F.count(F.lit(1)).alias("n_shared"))
        .where(F.col("n_shared") >= F.ceil(F.round(F.lit(threshold) * F.col("n"), 9)))
        .select("doc_id", "item_id", "n_shared", F.col("n").alias("n_shingles"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item; same columns.

    Texts are told apart by a 64-bit hash, so that doc_id plays no part: rows without one, or with one that repeats,
    go or stay by their texts, repeated rows alike.  Null and empty texts stay; an empty table gives no rows, an empty
    benchmark keeps all.
    """
    name, of = free(docs, "_bad"), F.xxhash64(F.col("text").cast("string"))
    found = contained_items(docs.select(of.alias("doc_id"), "text"), benchmark)
    bad = materialise(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(_small(bad, F.lit(8)), of == F.col(name), "left_anti")


_LIST = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE}+'), lambda x: x <> '')"
_SHINGLE = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(WIDTH))
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, w, least(len(w), {WIDTH}) AS m FROM (SELECT item_id, {_LIST} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, {_SHINGLE} AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM b WHERE m = {WIDTH})
      UNION SELECT item_id, array_to_string(w, ' ') FROM b WHERE m < {WIDTH}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
t AS (SELECT doc_id, {_LIST} AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, {_SHINGLE} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM t)
      UNION SELECT doc_id, array_to_string(w[i:i + m - 1], ' ')
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM t, (SELECT DISTINCT m FROM b WHERE m < {WIDTH})))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles, round(count(*) / any_value(n)::DOUBLE, 6) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(round({THRESHOLD} * any_value(n), 9))"""
