import pytest
from pyspark.sql import functions as F

from granary.errors import EmptyData, InvalidParameter, NotFitted
from granary.operators import profile as P
from granary.operators import scaling as S


def test_issues_and_score(spark):
    df = spark.createDataFrame([("", "1"), ("a", "1")], "a string, b string")
    found = P.issues(df).collect()
    assert found[0].issue == "MissingValues" and found[0].severity == "Error" and found[0].affected == 1
    assert [r.issue for r in P.issues(spark.createDataFrame([("1",), ("1",), ("2",)], "a string")).collect()] == ["Duplicates"]
    assert tuple(P.quality_score(P.issues(df)).first()) == (85, "yellow")
    clean = spark.createDataFrame([("a",), ("b",)], "a string")
    assert tuple(P.quality_score(P.issues(clean)).first()) == (100, "green")


def test_outliers_and_variance(spark):
    rows = [(str(i % 10), "7", f"t{i}") for i in range(100)] + [("1000", "7", "t")] * 3
    df = spark.createDataFrame(rows, "a string, b string, c string")
    out = {r.column: r.n_outliers for r in P.outliers(df).collect()}
    assert out == {"a": 3, "b": 0}
    assert {r.column: r.low for r in P.low_variance(df).collect()} == {"a": False, "b": True}
    assert {r.column for r in P.cardinality(df).where("high").collect()} == {"c"}


def test_dtypes(spark):
    rows = [(str(i), str(i % 2), ["red", "blue"][i % 2], f"2024-01-{i + 10}", "  ", f"some words {i}") for i in range(12)]
    got = {r.column: r.dtype for r in P.dtypes(spark.createDataFrame(rows, "n string, b string, c string, d string, u string, t string")).collect()}
    assert got == {"n": "Numeric", "b": "Binary", "c": "Categorical", "d": "DateTime", "u": "Unknown", "t": "Text"}


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1.0, 2.0, 5.0), (3.0, 4.0, 5.0), (5.0, 6.0, 5.0)], "a double, b double, c double")


@pytest.mark.parametrize("make", [S.StandardScaler, S.MinMaxScaler, S.RobustScaler, lambda: S.MinMaxScaler(-1, 1)])
def test_inverse_is_identity(df, make):
    m = make().fit(df, ["a", "b", "c"])
    assert [tuple(r) for r in m.inverse_transform(m.transform(df)).collect()] == [pytest.approx(tuple(r)) for r in df.collect()]


def test_scalers(spark, df):
    assert S.StandardScaler().fit(df, ["a", "b"]).mean == [3, 4]
    assert [tuple(r) for r in S.MinMaxScaler().fit_transform(df, ["a", "c"]).select("a", "c").collect()] == [(0, 0), (0.5, 0), (1, 0)]
    assert S.RobustScaler().fit(df, ["a", "c"]).describe(spark).collect()[1].scale == 1.0
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "a double")
    assert S.MinMaxScaler().fit(nan, ["a"]).data_max == [3.0]
    with pytest.raises(NotFitted, match="Scaler not fitted"):
        S.StandardScaler().transform(df)
    with pytest.raises(EmptyData, match="Cannot fit on empty data"):
        S.StandardScaler().fit(df.where("false"), ["a"])
    with pytest.raises(InvalidParameter):
        S.MinMaxScaler(1, 1)


def test_imputer_and_encoder(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", None), ("x", 3.0), ("z", 3.0)], "k string, v double")
    fill = lambda s: [r.v for r in S.Imputer(s, 9).fit_transform(df, ["v"]).collect()][1]
    assert [fill(s) for s in ("mean", "median", "most_frequent", "constant")] == [pytest.approx(7 / 3), 3, 3, 9]
    e = S.LabelEncoder().fit(df, "k")
    out = e.transform(df)
    assert {(r.k, r.code) for r in out.collect()} == {("x", 0), ("y", 1), ("z", 2)}
    assert e.inverse_transform(out.drop("k").select("v", "code")).where(F.col("category") == "x").count() == 2


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, kind string")
    rows = {r["id"]: r["features"] for r in S.LabelEncoder().fit(df, "kind").one_hot(df).collect()}
    assert rows == {1: [0.0, 1.0], 2: [1.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 1.0]}
