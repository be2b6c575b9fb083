import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.errors import DimensionMismatch
from granary.operators import linalg as L
from granary.operators import table as T


def cells(df):
    return {(r.i, r.j): r.v for r in df.collect()}


def test_matrices(spark):
    a = L.from_values(spark, [1, 2, 3, 4, 5, 6], 2, 3)
    b = L.from_rows(spark, [[1, 2], [3, 4]])
    assert cells(a)[1, 2] == 6 and tuple(L.shape(a).first()) == (2, 3) and cells(L.transpose(a))[2, 1] == 6
    assert cells(L.multiply(b, L.from_rows(spark, [[5, 6], [7, 8]]))) == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}
    rows = L.packed(a)
    assert {r.row_id: r.v for r in L.times_vector(rows, [1, 2, 3]).collect()} == {0: 14, 1: 32}
    assert cells(L.combine(a, a, -1)) == {k: 0 for k in cells(a)} and cells(L.coordinates(rows)) == cells(a)
    assert cells(L.identity(spark, 2)) == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1} and len(cells(L.filled(spark, 2, 3, 1.0))) == 6
    assert [r.v for r in L.get(a, 0, 1).collect()] == [2] and L.get(a, 5, 5).count() == 0
    with pytest.raises(DimensionMismatch, match="Data length 3 doesn't match dimensions 2x2"):
        L.from_values(spark, [1, 2, 3], 2, 2)
    with pytest.raises(DimensionMismatch):
        L.from_rows(spark, [[1], [1, 2]])


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 5.0], [1, 2, 3], [2, 3, 1])], "a array<double>, b array<double>, c array<int>, d array<int>")
    one = lambda c: df.select(c).first()[0]
    assert one(L.dot("a", "b")) == 25 and one(L.elementwise("c", "d", "div")) == [0, 0, 3] and one(L.elementwise("a", "b", "+")) == [3, 6, 8]
    assert one(L.with_scalar("a", 2.0, "*")) == [2, 4, 6] and one(L.euclidean("a", "b")) == pytest.approx(3.0)
    assert one(L.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 2 and one(L.argmax(F.expr("CAST(array() AS array<double>)"))) == 0
    with pytest.raises(Exception, match="same length"):
        one(L.dot("a", F.array(F.lit(1.0))))
    assert cells(L.outer(spark, [1, 2], [3, 4])) == {(0, 0): 3, (0, 1): 4, (1, 0): 6, (1, 1): 8}


def test_eigen():
    a = np.array([[2.0, 1.0], [1.0, 2.0]])
    value, vector = L.power_iteration(a)
    assert value == pytest.approx(3) and np.allclose(np.abs(vector), 2**-0.5)
    assert np.allclose(L.deflate(a, value, vector) @ vector, 0)
    values, vectors = L.top_eigen(np.array([[1.0, -1.0], [-1.0, 1.0]]), 2)
    assert len(values) == 1 and values[0] == pytest.approx(2)


def test_table_operators(spark):
    df = spark.createDataFrame([(0, "Apple", "10"), (1, "pear", "9"), (2, None, "x"), (3, "fig", "9")], "id int, name string, v string")
    assert [r.id for r in T.any_cell_contains(df, "APP").collect()] == [0] and T.any_cell_contains(df, "").count() == 4
    assert [r.id for r in T.sort_by(df, "v", "id").collect()] == [1, 3, 0, 2] and [r.id for r in T.sort_by(df, "v", "id", True).collect()] == [2, 0, 1, 3]
    assert T.toggle_sort(("a", False), "a") == ("a", True) and T.toggle_sort(("a", True), "b") == ("b", False)
    assert [r.id for r in T.page(df, ["id"], 45, visible=1, overscan=1).collect()] == [1, 2]
    assert [r.row_number for r in T.row_numbers(df, "id").orderBy("id").collect()] == [1, 2, 3, 4]
    names = T.catalog(df)
    assert [r.name for r in T.search(names, "NA").collect()] == ["name"] and [r.name for r in T.available(names, ["id"], "v").collect()] == ["name"]
    assert T.select(df, ["v", "nope", "id"]).columns == ["v", "id"] and T.toggle(["a"], "a") == [] and T.reorder(["a", "b", "c"], 0, 2) == ["b", "c", "a"]
    m = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id int, features array<double>")
    assert [r.value for r in T.matrix_column(m, 1).collect()] == [2, 4] and T.matrix_column(m, 9).count() == 0 and T.matrix_row(m, 1).first().features == [3, 4]
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, float("nan"), float("inf"), 3])], "i int, v double")
    assert tuple(T.finite_bounds(s, "v").first()) == (2, 1.0, 3.0, 2.0) and T.counts(s, s) == {"shown": 4, "total": 4, "columns": 2}


@pytest.mark.parametrize("text, want", [("5", 5), ("-.5", -0.5), ("1e5", 1e5), ("5.", 5), ("+inf", float("inf")), (" 5 ", None), ("5d", None), ("1_0", None), ("", None), ("0x1", None), ("abc", None)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(T.number(F.col("s"))).first()[0] == want


def test_shapes_and_places_are_checked(spark):
    a, b = L.from_rows(spark, [[1, 2], [3, 4]]), L.from_rows(spark, [[1, 2, 3], [4, 5, 6]])
    assert L.at(a, 1, 0) == 3.0 and cells(L.multiply(a, b))[1, 2] == 33.0
    for wrong in (lambda: L.at(a, 2, 0), lambda: L.combine(a, b), lambda: L.multiply(b, a)):
        with pytest.raises(DimensionMismatch):
            wrong()


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 101).alias("k"), "id").repartition(7)
    out = T.numbered(df, [F.col("k").desc(), F.col("id")], "place").collect()
    assert [(r.k, r.id) for r in sorted(out, key=lambda r: r.place)] == sorted(((r.k, r.id) for r in out), key=lambda x: (-x[0], x[1]))
    assert sorted(r.place for r in out) == list(range(1, 1001))


def test_numbering_keeps_the_users_columns(spark):
    df = spark.createDataFrame([(i, i * 2, "x", i, i, i) for i in range(50)], "k int, _part int, _of string, _before int, _rows int, n int")
    out = T.numbered(df, [F.col("k").desc()], "place")
    assert out.columns == [*df.columns, "place"]
    assert all((r.place, r._part, r._of, r._before, r.n) == (50 - r.k, 2 * r.k, "x", r.k, r.k) for r in out.collect())
    assert T.numbered(df, [F.col("k")], "n").columns == df.columns
