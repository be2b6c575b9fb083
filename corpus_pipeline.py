"""A training corpus from raw documents: toxicity, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, decontaminate, jaccard, pii, toxicity
from granary.llm.common import lean_workers, shared_folder, table


def stage(run):
    """A stage of the pipeline, whose Python workers keep no memory that they don't use."""

    @functools.wraps(run)
    def lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean_workers(spark)
        return run(spark, docs, sf_dir)

    return lean


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; the model learns from the labelled ones among them.

    Null and empty texts stay; repeats are judged alike; an empty table, or one without labels, is judged by the
    built-in words; clashing column names are no matter in any stage.
    """
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of smallest id (nulls last).

    Texts without words (null, empty, white) are one group; an empty table gives no rows.
    """
    return jaccard.keep_one(docs)


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts, and items, contain nothing; repeats are judged alike; with either table empty all rows stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    Every row stays; null texts stay null; repeats are changed alike.
    """
    return pii.redact(docs)


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text, of each document that is left.

    A null text counts as an empty one; repeats get equal rows; an empty table gives none.
    """
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("bpe encoding", tokenize),
]

#: No stage's decisions (a trained model, components, a tokenizer) can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written to the cluster's shared folder and read again.

    A stage's table is removed once the next one's is written; the last one's stays, as the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
