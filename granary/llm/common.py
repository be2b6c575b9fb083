"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import materialise, shared_folder  # noqa: F401

#: ASCII white space as a character class that Java and DuckDB regular expressions share.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Tables are broadcast up to so many bytes, and shuffled beyond that.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_workers(spark: SparkSession) -> None:
    """Python workers give large blocks of memory back when they free them, so that what one stage took isn't there still
    in the next one.  Settings of the cluster's own stand."""
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_MMAP_THRESHOLD_", str(1 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(1 << 20)), ("MALLOC_ARENA_MAX", "2")):
        spark.sparkContext.environment.setdefault(name, value)


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have: the given one, with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text):
    """The words (runs of other than ASCII white space) of a text column; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def placed(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``i``, each row's place among those of one ``by`` (a string without nulls) from 0, and ``n``, their number.

    No task sees all rows of a ``by``: rows are sorted over ranges, and a range's numbers start after what the ranges
    before it hold.  Rows equal in everything are told apart by where they lie, so that any number of them spreads over the ranges.
    """
    rows = df.withColumn("lies", F.monotonically_increasing_id())
    keys = [by, *order, "lies"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows.drop("lies").withColumn("part", F.shiftright("at", 33)))
    # a row for each part, and one more for each key that begins in it
    runs = rows.groupBy(by, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select(by, "part", (earlier - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy(by)).alias("n")))
    size = runs.agg(F.sum(F.octet_length(by) + 32)).first()[0] or 0
    runs = F.broadcast(runs) if size <= BROADCAST_BYTES else runs
    return rows.join(runs, [by, "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")
