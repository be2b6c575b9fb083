"""The registered queries of the training-data operators, and the SQL they are held against."""

from __future__ import annotations

from . import bpe, decontaminate, lexical, licenses, merkle, pii, positives, quality, secrets, sharding, simhash, substrings, toxicity
from .common import table


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark, sf_dir):
    return substrings.digest(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), words=bpe.ALONE_WORDS)


def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_pii(spark, sf_dir):
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark, sf_dir):
    return positives.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_sharding": op6_sharding,
    "op7_secret_scan": op7_secret_scan,
    "op8_pii": op8_pii,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.ORACLE_SQL,
    "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op6_sharding": sharding.ORACLE_SQL,
    "op9_license_scan": licenses.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_ranked_search": lexical.ORACLE_SQL,
}
