"""Data profiling and quality scoring of string tables.

Columns are unpivoted once and summarised by one aggregate, whatever their number.  A cell that is null or blank after
trimming is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import long_percentiles
from .table import number

SEVERITIES = ("Info", "Warning", "Error", "Critical")


def _long(df: DataFrame) -> DataFrame:
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    out = cells.unpivot([], df.columns, "column", "cell")
    return out.select("column", pos[F.col("column")].alias("position"), F.col("cell"), number(F.col("cell")).alias("num"))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def missing(df: DataFrame) -> DataFrame:
    """``column, position, n_rows, n_missing, pct, severity``, for every column."""
    out = _long(df).groupBy("column", "position").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(blank(F.col("cell"))).alias("n_missing"))
    return out.withColumn("pct", missing_percent(F.col("n_missing"), F.col("n_rows"))).withColumn("severity", missing_severity(F.col("pct")))


def missing_percent(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0))


def missing_severity(pct: Column) -> Column:
    return F.when(pct > 50, "Critical").when(pct > 20, "Error").when(pct > 5, "Warning").otherwise("Info")


def outliers(df: DataFrame) -> DataFrame:
    """``column, position, n_numeric, q1, q3, n_outliers, pct``: strictly outside 1.5 interquartile ranges, for columns
    where more than half of the rows are numbers."""
    long = _long(df)
    sizes = long.groupBy("column", "position").agg(F.count(F.lit(1)).alias("n_rows"), F.count("num").alias("n_numeric"))
    # a row a column on either side
    q = sizes.join(F.broadcast(long_percentiles(long.select("column", F.col("num").alias("value")), [0.25, 0.75])), "column")
    q = q.where("n_numeric > n_rows div 2").select("column", "position", "n_numeric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("num") < F.col("q1") - 1.5 * iqr) | (F.col("num") > F.col("q3") + 1.5 * iqr)
    # one row a column
    counted = long.join(F.broadcast(q), ["column", "position"]).groupBy("column", "position", "n_numeric", "q1", "q3").agg(F.count_if(out).alias("n_outliers"))
    return counted.withColumn("pct", F.col("n_outliers") * 100.0 / F.col("n_numeric"))


def low_variance(df: DataFrame) -> DataFrame:
    """``column, position, n_numeric, std_dev, low``."""
    out = _long(df).groupBy("column", "position").agg(F.count(F.lit(1)).alias("n_rows"), F.count("num").alias("n_numeric"), F.coalesce(F.stddev_pop("num"), F.lit(0.0)).alias("std_dev"))
    return out.where("n_numeric > n_rows div 2").select("column", "position", "n_numeric", "std_dev", ((F.col("n_numeric") > 10) & (F.col("std_dev") < 0.01)).alias("low"))


def cardinality(df: DataFrame) -> DataFrame:
    """``column, position, n_distinct, ratio, high`` of the cells that are not blank."""
    out = _long(df).groupBy("column", "position").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(~blank(F.col("cell")), F.col("cell"))).alias("n_distinct"))
    ratio = F.col("n_distinct") / F.col("n_rows")
    return out.select("column", "position", "n_distinct", ratio.alias("ratio"), ((F.col("n_distinct") > 50) & (ratio > 0.5)).alias("high"))


def duplicates(df: DataFrame) -> DataFrame:
    """``n_rows, n_duplicates, pct``: rows beyond the first of each; groups are counted map side first."""
    groups = df.groupBy(*df.columns).count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates")).withColumn(
        "pct", missing_percent(F.col("n_duplicates"), F.col("n_rows"))
    )


def dtypes(df: DataFrame) -> DataFrame:
    """``column, position, dtype``: Unknown, Binary, Numeric, Categorical, DateTime or Text."""
    cell = F.when(~blank(F.col("cell")), F.col("cell"))
    s = _long(df).groupBy("column", "position").agg(
        F.count(cell).alias("n"),
        F.count(F.when(cell.isNotNull(), F.col("num"))).alias("numbers"),
        F.count_distinct(cell).alias("distinct"),
        F.count_if(cell.rlike("[-/:T]")).alias("dated"),
        F.count_if(~cell.isin("0", "1")).alias("others"),
    )
    kind = (
        F.when(F.col("n") == 0, "Unknown")
        .when((F.col("numbers") == F.col("n")) & (F.col("others") == 0) & (F.col("distinct") == 2), "Binary")
        .when(F.col("numbers") == F.col("n"), "Numeric")
        .when((F.col("distinct") < 10) | (F.col("distinct") / F.col("n") < 0.05), "Categorical")
        .when(F.col("dated") / F.col("n") > 0.8, "DateTime")
        .otherwise("Text")
    )
    return s.select("column", "position", kind.alias("dtype"))


def issues(df: DataFrame) -> DataFrame:
    """``column, issue, severity, affected, pct, recommendation``: most severe first, then by column and check."""
    whole = F.lit(0).cast("long")
    m = missing(df).where("n_missing > 0")
    advice = F.when(F.col("pct") > 50, "Consider dropping this column").when(F.col("pct") > 20, "Impute or investigate the missing values").otherwise("Impute the missing values")
    parts = [
        m.select("column", "position", F.lit(0).alias("check"), F.lit("MissingValues").alias("issue"), "severity", F.col("n_missing").alias("affected"), "pct", advice.alias("recommendation")),
        outliers(df).where("pct > 1").select("column", "position", F.lit(1), F.lit("Outliers"), F.when(F.col("pct") > 10, "Warning").otherwise("Info"), "n_outliers", "pct", F.lit("Check or cap the outliers")),
        low_variance(df).where("low").select("column", "position", F.lit(2), F.lit("LowVariance"), F.lit("Warning"), whole, F.lit(0.0), F.lit("Consider dropping this column")),
        cardinality(df).where("high").select("column", "position", F.lit(3), F.lit("HighCardinality"), F.lit("Info"), "n_distinct", F.col("ratio") * 100, F.lit("Consider encoding or grouping")),
        duplicates(df).where("n_duplicates > 0").select(F.lit("Dataset"), F.lit(len(df.columns)), F.lit(4), F.lit("Duplicates"), F.when(F.col("pct") > 10, "Warning").otherwise("Info"), "n_duplicates", "pct", F.lit("Remove duplicate rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return out.orderBy(rank.desc(), "position", "check").select("column", "issue", "severity", "affected", "pct", "recommendation")


def quality_score(found: DataFrame) -> DataFrame:
    """``score, band`` of a table's issues."""
    points = F.lit(0)
    for s, p in zip(SEVERITIES, (1, 5, 15, 25)):
        points = points + F.count_if(F.col("severity") == s) * p
    score = 100 - F.least(points, F.lit(100))
    return found.agg(score.cast("long").alias("score")).withColumn("band", score_band(F.col("score")))


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "green").when(score >= 70, "yellow").when(score >= 50, "orange").otherwise("red")
