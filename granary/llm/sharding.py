"""Sharding by proportional stratified interleaving.

Rows of each source are put into a seeded random order and get the fractional rank (rank - 1/2) / size; all rows are
sorted by it and cut into shards of equal counts, so each shard holds every source in proportion.  Law: ``rows``.

Both numberings are over ranges of the order (``common.placed``), so neither a source, nor the table, nor the rows that
share a rank (those of all sources of one row, say) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, placed

SHARDS = 16
SEED = 17
#: Where rows tie, what orders them; rows equal in all of these are alike in the result.
TIES = ("doc_id", "text_crc32", "size")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, source`` for each row of documents.

    Null texts count as empty ones (size 1).  A null source is a source of its own; the random key is that of doc_id,
    size and text, so null and repeated ids spread as well.  Rows equal in all of these get neighbouring places; an
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", part("doc_id"), part("size"), part("text_crc32"), F.lit(str(seed))))
    of = F.concat(F.when(F.col("source").isNull(), "").otherwise("s"), part("source"))
    ranked = placed(materialise(rows.withColumn("key", key).withColumn("of", of)), "of", ["key", *TIES])
    fraction = (F.lit(2.0) * (F.col("i") + 1) - 1) / (F.lit(2.0) * F.col("n"))
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "key", fraction.alias("fraction"), F.lit("").alias("all"))
    return (
        placed(materialise(ranked), "all", ["fraction", "key", *TIES])
        .withColumn("shard", F.expr(f"CAST(i * {shards} div n AS INT)"))
        .select(
            "doc_id", "size", "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"i - (CAST(shard AS BIGINT) * n + {shards - 1}) div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "source",
        )
    )


ORACLE_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i::BIGINT)) AS t),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
e AS (SELECT doc_id, source, size, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, t),
c AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':{SEED}') AS key FROM e),
r AS (SELECT *, (2.0::DOUBLE * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS fraction FROM c),
g AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM r),
s AS (SELECT *, (g * {SHARDS} // n)::INT AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, g - (shard::BIGINT * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, source FROM s"""
