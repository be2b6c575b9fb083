"""Strict labelled CSV, previews, text and parquet sources, and sinks."""

from __future__ import annotations

import csv
import io
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CsvError, EmptyDataset, InconsistentRow, InvalidParameter, InvalidValue, ParseError, TargetNotFound
from ..operators.table import FINITE, NUMBER, is_whole

MAX_UPLOAD = 10 * 1024 * 1024
# The preset points.
PRESETS = {
    "linear": [(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (4.0, 9.0), (5.0, 11.0)],
    "steep": [(1.0, 5.0), (2.0, 10.0), (3.0, 15.0), (4.0, 20.0)],
    "noisy": [(1.0, 3.2), (2.0, 4.8), (3.0, 7.1), (4.0, 8.9), (5.0, 11.3)],
}


@dataclass
class Dataset:
    """Features, a target and a row number, all doubles but the last."""

    df: DataFrame
    feature_names: list[str]
    target: str

    def count(self) -> int:
        return self.df.count()


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader(io.StringIO(first[0]["value"]))) if first else []


def load_csv(spark: SparkSession, path: str, target: str, multi_line: bool = False) -> Dataset:
    """A CSV file, or a folder of them, with headers and otherwise finite numbers only; the first offending cell is
    reported.

    Target cells are looked at before a row's features; unequal rows fail.  Files are read by Spark's own reader, split
    over tasks, and not inferred.  Rows are numbered by file name and place in the file; an error has its file and the
    line in it, counted by records without blank lines.  Quoted cells may hold line ends (no such cell is a number): a
    file that seems to have unequal rows is read once more without splitting it, which multi_line asks for at once.
    """
    names = header(spark, path)
    if target not in names:
        raise TargetNotFound(target)
    try:
        return _validated(_read(spark, path, names, multi_line), names, target)
    except InconsistentRow:
        if multi_line:
            raise
    return _validated(_read(spark, path, names, True), names, target)


def _read(spark: SparkSession, path: str, names: list[str], multi_line: bool = False) -> DataFrame:
    """``_row, _file, _line, _cells, _raw``: _raw is a row with too many or too few cells, whose cells are then one too
    many."""
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "_raw string"])
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_raw", escape='"', multiLine=multi_line)
    cells = F.array(*[F.coalesce(f"c{i}", F.lit("")) for i in range(len(names))])
    cells = F.when(F.col("_raw").isNull(), cells).otherwise(F.array_append(cells, F.lit("")))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = rows.select(cells.alias("_cells"), "_raw", *place).withColumn("_at", F.monotonically_increasing_id())
    # a row for each part of a file that one task reads
    parts = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_file", "_block", "_first", earlier(W.orderBy("_file", "_block")).alias("_all"), earlier(W.partitionBy("_file").orderBy("_block")).alias("_own"))
    out = rows.join(F.broadcast(parts), ["_file", "_block"])
    inside = F.col("_at") - F.col("_first")
    return out.select((F.col("_all") + inside).alias("_row"), "_file", (F.col("_own") + inside + 2).alias("_line"), "_cells", "_raw")


def load_content(spark: SparkSession, content: str, target: str) -> Dataset:
    """The same from text in hand (quoted fields may span lines)."""
    records = [r for r in csv.reader(io.StringIO(content))]
    records = [(i + 1, r) for i, r in enumerate(records) if r]
    names = records[0][1] if records else []
    if target not in names:
        raise TargetNotFound(target)
    df = spark.createDataFrame(records[1:], T.StructType([T.StructField("_line", T.LongType()), T.StructField("_cells", T.ArrayType(T.StringType()))]))
    return _validated(df, names, target)


def _validated(df: DataFrame, names: list[str], target: str) -> Dataset:
    at = names.index(target)
    order = [at, *[i for i in range(len(names)) if i != at]]
    raw = F.col("_raw") if "_raw" in df.columns else F.lit(None).cast("string")
    ragged = F.when(F.size("_cells") != len(names), F.struct(F.when(raw.isNull(), -1).otherwise(-2).alias("p"), F.coalesce(raw, F.size("_cells").cast("string")).alias("value")))
    bad = ragged
    for p in reversed(range(len(order))):
        cell = F.get("_cells", F.lit(order[p]))
        this = F.when(~F.coalesce(is_whole(cell, FINITE), F.lit(False)), F.struct(F.lit(p).alias("p"), cell.alias("value")))
        bad = F.coalesce(this, bad) if p != len(order) - 1 else this
    bad = F.coalesce(ragged, bad)
    file = F.col("_file") if "_file" in df.columns else F.lit(None).cast("string")
    place = F.struct(file.alias("file"), "_line")
    n, first = df.withColumn("_bad", bad).agg(F.count(F.lit(1)), F.min_by(F.struct(place.alias("place"), "_bad"), F.when(F.col("_bad").isNotNull(), place))).first()
    if not n:
        raise EmptyDataset()
    if first is not None and first["_bad"] is not None:
        line, p, value = first["place"]["_line"], first["_bad"]["p"], first["_bad"]["value"]
        if p < 0:
            error = InconsistentRow(line, len(names), _fields(value) if p == -2 else int(value))
        else:
            error = (InvalidValue if re.match(rf"(?:{NUMBER})\Z", value or "") else ParseError)(line, names[order[p]], value or "")
        error.file = first["place"]["file"]
        raise error
    cols = [F.get("_cells", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]
    features = [c for i, c in enumerate(names) if i != at]
    row = F.col("_row") if "_row" in df.columns else F.col("_line") - 2
    return Dataset(df.select(row.alias("row_id"), *cols), features, target)


def _fields(record: str) -> int:
    return len(next(csv.reader(io.StringIO(record)), []))


def preview(spark: SparkSession, path: str, rows: int = 10) -> dict:
    """Headers, the first rows as strings, and the number of rows; unequal rows fail.  Line ends as in ``load_csv``."""
    names = header(spark, path)
    for multi_line in (False, True):
        df = _read(spark, path, names, multi_line)
        ragged = df.where("_raw IS NOT NULL").orderBy("_row").limit(1).collect()
        if not ragged:
            return {"headers": names, "rows": [r["_cells"] for r in df.orderBy("_row").limit(rows).collect()], "total_rows": df.count()}
    raise InconsistentRow(ragged[0]["_line"], len(names), _fields(ragged[0]["_raw"]))


def check_upload(path: str, limit: int = MAX_UPLOAD) -> None:
    if not path.lower().endswith(".csv"):
        raise CsvError("Only .csv files are supported")
    if os.path.getsize(path) > limit:
        raise CsvError(f"File is larger than {limit} bytes")


def default_target(names: list[str], playground: bool = False) -> str:
    """The last column; the playground takes the first."""
    return names[0 if playground else -1]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def head(spark: SparkSession, path: str, n: int) -> str:
    """The first n lines; an empty file gives an empty text."""
    return "\n".join(r["value"] for r in spark.read.text(path).limit(n).collect())


def preset(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(PRESETS.get(name, []), "x double, y double")


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def write_note(spark: SparkSession, path: str, text: str, mode: str = "overwrite") -> None:
    """A text note; mode "append" adds a file to the folder."""
    if mode not in ("overwrite", "append"):
        raise InvalidParameter(f"Unknown mode '{mode}'")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def to_json(table: DataFrame) -> DataFrame:
    """Rows as JSON, for exporting a model's table."""
    return table.select(F.to_json(F.struct("*")).alias("json"))
