import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import common as C
from granary.llm import sharding as S

from .helpers import ODD, clashing, documents


@pytest.mark.parametrize("parts", ["4", "23"])
def test_shards(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    texts = ODD + [f"text {i % 50}" for i in range(500)]
    docs = documents(spark, texts, lambda i: None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}")
    try:
        rows = S.shard(clashing(docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for source, n in Counter(r.source for r in rows).items():
        by = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(by[s] - n / 16) <= 2 for s in range(16))


def test_partitions_do_not_change_the_result(spark):
    docs = documents(spark, [f"t{i}" for i in range(200)])
    assert sorted(S.shard(docs.repartition(7)).collect()) == sorted(S.shard(docs).collect())


def test_many_sources_of_one_row_spread_over_tasks(spark):
    """All have the same fractional rank, yet no task numbers more than its share of them."""
    docs = spark.range(100_000).selectExpr("id AS doc_id", "'text' AS text", "CAST(id AS STRING) AS source")
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        rows = C.placed(docs.selectExpr("*", "'' AS every", "0.5 AS fraction"), "every", ["fraction"])
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        out = S.shard(docs).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 100_000 and max(sizes) < 20_000
    assert [(r.n, r.lo, r.hi, r.d) for r in out] == [(6250, 0, 6249, 6250)] * 16


def test_empty_and_repeated(spark):
    assert S.shard(documents(spark, [])).count() == 0
    docs = documents(spark, ["a"])
    assert sorted((r.shard, r.slot) for r in S.shard(docs.union(docs)).collect()) == [(0, 0), (8, 0)]
