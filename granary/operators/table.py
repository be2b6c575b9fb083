"""Filtering, sorting, paging and projecting tables of strings and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import materialise

#: What counts as a number: a plain decimal with optional sign, fraction and exponent, or an infinity or NaN by name.
NUMBER = r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))"
FINITE = r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)"


def is_whole(c: Column, pattern: str) -> Column:
    """Whether a pattern covers a whole string, a line end at its end included."""
    return c.rlike(rf"\A(?:{pattern})\z")


def number(c: Column) -> Column:
    """The number a string holds, or null: casts alone would also take blanks and suffixes."""
    return F.when(is_whole(c, NUMBER), c.try_cast("double"))


def any_cell_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the needle in any cell, whatever its case; an empty needle keeps all."""
    q = needle.lower()
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in df.columns]
    return df if not q else df.where(reduce(Column.__or__, hits))


def sort_keys(column: str, row_id: str, descending: bool = False) -> list[Column]:
    """Order of a string column: numbers by value, then other strings by bytes, then row order."""
    c = F.col(column).cast("string")
    n = number(c)
    keys = [n.isNull(), n, c]
    return [*((k.desc() if descending else k.asc()) for k in keys), F.col(row_id).asc()]


def sort_by(df: DataFrame, column: str, row_id: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*sort_keys(column, row_id, descending))


def toggle_sort(state: tuple[str, bool] | None, column: str) -> tuple[str, bool]:
    """(column, descending) after a click on a header: the same column flips, another starts ascending."""
    return (column, not state[1]) if state and state[0] == column else (column, False)


def page(df: DataFrame, order: list, scroll: float = 0.0, row_height: int = 40, visible: int = 20, overscan: int = 5) -> DataFrame:
    """The rows in view: limit and offset over a total order, so Spark keeps only the top rows of each task."""
    start = int(scroll // row_height)
    return df.orderBy(*order).offset(start).limit(visible + overscan)


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have: the given one, with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place in an order, from 1, without a task that sees all rows: rows are sorted over ranges of the
    order, and a range's numbers start after what the ranges before it hold.

    A column of the given name is replaced; all others stay, whatever they are called.
    """
    part, of, before = (free(df, x) for x in ("_part", "_of", "_before"))
    rows = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    parts = rows.groupBy(F.col(part).alias(of)).agg(F.count(F.lit(1)).alias("n"))  # a row a task
    parts = parts.select(of, F.coalesce(F.sum("n").over(W.orderBy(of).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order))
    out = rows.withColumn(name, inside).join(F.broadcast(parts), F.col(part) == F.col(of))
    return out.withColumn(name, F.col(name) + F.col(before)).drop(part, of, before)


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    return numbered(df, [F.col(order)], "row_number")


def counts(shown: DataFrame, total: DataFrame) -> dict[str, int]:
    return {"shown": shown.count(), "total": total.count(), "columns": len(total.columns)}


def catalog(df: DataFrame) -> DataFrame:
    """``position, name, dtype`` of a table's columns."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, name string, dtype string")


def search(names: DataFrame, query: str) -> DataFrame:
    return names.where(F.lower("name").contains(query.lower()))


def available(names: DataFrame, selected: list[str], target: str | None = None) -> DataFrame:
    return names.where(~F.col("name").isin(*selected, *([target] if target else []), ""))


def select(df: DataFrame, selected: list[str]) -> DataFrame:
    """The selected columns in the user's order; unknown names are dropped."""
    return df.select(*[c for c in selected if c in df.columns])


def toggle(selected: list[str], name: str) -> list[str]:
    return [s for s in selected if s != name] if name in selected else [*selected, name]


def reorder(selected: list[str], src: int, dst: int) -> list[str]:
    out = list(selected)
    out.insert(dst, out.pop(src))
    return out


def matrix_row(df: DataFrame, i: int) -> DataFrame:
    return df.where(F.col("row_id") == i)


def matrix_column(df: DataFrame, j: int) -> DataFrame:
    """``row_id, value`` of column j of a packed matrix; no rows if j is out of bounds."""
    return df.select("row_id", F.get("features", F.lit(j)).alias("value")).where("value IS NOT NULL")


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def sample_steps(df: DataFrame, order: str, n: int, parts: int = 10) -> DataFrame:
    """Every max(n / parts, 1)-th entry of a history of n, ``parts`` of them at most."""
    return df.where(F.col(order) % max(n // parts, 1) == 0).orderBy(order).limit(parts)


def finite_bounds(df: DataFrame, column: str, floor: float = 1e-10) -> DataFrame:
    """``n, lo, hi, range`` of the finite values of a series; the range is floored."""
    v = F.col(column).cast("double")
    ok = df.select(v.alias("v")).where(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    return ok.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.greatest(F.max("v") - F.min("v"), F.lit(floor)).alias("range"))
