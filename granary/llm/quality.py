"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, words

#: Frequent function words of English, German, French and Spanish, as written inside a sentence (lower case).
STOP_WORDS = (
    "the of and to in is that it for was with be by on are this from as or an a at he they not "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les du un une que dans pour par sur qui il elle au est en avec ou "
    "el y los se las por con no una su para es al del lo"
).split()
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / max(denominator, 1) <= high``, over columns of the measures below; None: no bound."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> str:
        ratio = f"(CAST({self.numerator} AS DOUBLE) / CAST(greatest({self.denominator}, 1) AS DOUBLE))"
        bounds = [f"{ratio} >= CAST({self.low} AS DOUBLE)"] * (self.low is not None) + [f"{ratio} <= CAST({self.high} AS DOUBLE)"] * (self.high is not None)
        return "(" + " AND ".join(bounds) + ")"


#: The threshold table. Its conditions are plain SQL, read alike by Spark and by DuckDB.
RULES = (
    Rule("words", "n_words", "1", 50, None),
    Rule("mean word length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols to words", "n_symbols", "n_words", None, 0.3),
    Rule("exclamations to words", "n_exclamations", "n_words", None, 0.3),
    Rule("stop words to words", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated words to words", "n_repeat_words", "n_words", None, 0.5),
)
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def verdict(rules: tuple[Rule, ...] = RULES) -> str:
    return " AND ".join(r.holds() for r in rules)


def _long(c: Column) -> Column:
    return c.cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """One row per document with everything that rules may compare.

    Words of three-word windows that repeat are found inside the row: the windows' 64-bit hashes are sorted with their
    positions, equal neighbours mark repeats, and the positions they cover are counted; no row leaves its task.
    """
    empty = F.expr("CAST(array() AS array<int>)")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("w", words(F.col("text")))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)))
        .withColumn("n", F.size("w"))
        .withColumn(
            "h",
            F.when(
                F.col("n") >= 3,
                F.transform(
                    F.arrays_zip(
                        F.slice("w", F.lit(1), F.col("n") - 2).alias("a"), F.slice("w", F.lit(2), F.col("n") - 2).alias("b"), F.slice("w", F.lit(3), F.col("n") - 2).alias("c")
                    ),
                    lambda s: F.xxhash64(s["a"], s["b"], s["c"]),
                ),
            ),
        )
        .withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
        .withColumn("s", F.when(F.col("repeats"), F.sort_array(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(0), F.col("n") - 3).alias("p")))))
        .withColumn("m", F.size("s"))
        .withColumn(
            "p",
            F.when(
                F.col("s").isNotNull(),
                F.transform(
                    F.filter(
                        "s",
                        lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]),
                    ),
                    lambda x: x["p"],
                ),
            ).otherwise(empty),
        )
        .select(
            "doc_id",
            _long(F.col("n")).alias("n_words"),
            _long(F.length(F.array_join("w", ""))).alias("word_chars"),
            _long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
            _long(F.regexp_count("text", F.lit("!"))).alias("n_exclamations"),
            _long(F.size("lines")).alias("n_lines"),
            _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
            _long(F.size(F.array_distinct(F.concat("p", F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2))))).alias("n_repeat_words"),
            _long(F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS)))).alias("n_stop_words"),
        )
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A null text counts as an empty one: no words, base_failed.  Rows are judged one by one, so repeated rows and ties
    get equal results and an empty table gives none; a null doc_id stays null; other columns are not read.
    """
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"),
        F.expr(f"NOT {BASE_FAILED} AND {verdict(rules)}").alias("kept"),
    )


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS l
  FROM documents),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {BASE_FAILED} AS base_failed, NOT {BASE_FAILED} AND {verdict()} AS kept
FROM m"""
