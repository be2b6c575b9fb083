import pytest

from granary.errors import CsvError, EmptyDataset, InconsistentRow, InvalidValue, ParseError, TargetNotFound
from granary.plans.facade import fit_from_file
from granary.sources import csv as C


def write(tmp_path, text, name="t.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.fixture(params=["file", "content"])
def load(request, spark, tmp_path):
    return (lambda text, target: C.load_csv(spark, write(tmp_path, text), target)) if request.param == "file" else (lambda text, target: C.load_content(spark, text, target))


def test_valid(load):
    d = load("x1,x2,y\n1.0,2.0,3.0\n4.0,5.0,6.0\n", "y")
    assert d.feature_names == ["x1", "x2"] and d.count() == 2 and [tuple(r) for r in d.df.orderBy("row_id").collect()] == [(0, 1, 2, 3), (1, 4, 5, 6)]
    assert load("y,a,b\n1,2,3", "y").feature_names == ["a", "b"] and load("a,y,b\n-1.5,2,1e3", "y").feature_names == ["a", "b"]


@pytest.mark.parametrize(
    "text, error, where",
    [
        ("a,b\n1,2", TargetNotFound, None),
        ("x,y\n1.0,2.0\nabc,3.0", ParseError, (3, "x", "abc")),
        ("x,y\n1.0,abc", ParseError, (2, "y", "abc")),
        ("x,y\nbad,worse", ParseError, (2, "y", "worse")),
        ("x,y\n1,inf", InvalidValue, (2, "y", "inf")),
        ("x,y\nNaN,1", InvalidValue, (2, "x", "NaN")),
        ("x,y\n,1", ParseError, (2, "x", "")),
        ("x,y\n1,2\n1,2,3", InconsistentRow, None),
        ("x,y\n1", InconsistentRow, None),
        ("x,y\n", EmptyDataset, None),
        ("x,y", EmptyDataset, None),
        (" y,x\n1,2", TargetNotFound, None),
    ],
)
def test_errors(load, text, error, where):
    with pytest.raises(error) as e:
        load(text, "y")
    if where:
        assert (e.value.line, e.value.column, e.value.value) == where
    if error is ParseError and where == (3, "x", "abc"):
        assert str(e.value) == "Line 3, column 'x': failed to parse 'abc' as a number"


def test_preview_guards_and_text(spark, tmp_path):
    p = write(tmp_path, "a,b\n" + "".join(f"{i},{i}\n" for i in range(15)))
    v = C.preview(spark, p)
    assert v["headers"] == ["a", "b"] and len(v["rows"]) == 10 and v["total_rows"] == 15
    with pytest.raises(CsvError):
        C.preview(spark, write(tmp_path, "a,b\n1\n", "r.csv"))
    with pytest.raises(CsvError):
        C.check_upload("x.txt")
    with pytest.raises(CsvError):
        C.check_upload(p, 3)
    assert C.default_target(["a", "b"]) == "b" and C.default_target(["a", "b"], playground=True) == "a"
    assert C.head(spark, p, 2) == "a,b\n0,0" and C.lines(spark, p).count() == 16 and C.head(spark, write(tmp_path, "", "e.csv"), 3) == ""
    assert C.preset(spark, "linear").count() == 5 and C.preset(spark, "none").count() == 0


def test_sinks_and_fit(spark, tmp_path):
    out = str(tmp_path / "note")
    C.write_note(spark, out, "one")
    C.write_note(spark, out, "two", "append")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["one", "two"]
    m = fit_from_file(spark, write(tmp_path, "x,y\n1,3\n2,5\n3,7\n4,9\n5,11\n"), "y", 2000, 0.05)
    assert m.weights[0] == pytest.approx(2, abs=0.01)
    assert C.to_json(m.table(spark)).first().json.startswith('{"feature":"x"')


def test_quoted_cells_and_line_ends(spark, tmp_path):
    path = write(tmp_path, 'x,"y"\r\n"1.0","2"\r\n3,"4"\r\n')
    assert [tuple(r) for r in C.load_csv(spark, path, "y").df.orderBy("row_id").collect()] == [(0, 1, 2), (1, 3, 4)]
    broken = write(tmp_path, 'x,y\n1,2\n"3\n4",5\n', "b.csv")
    for load in (lambda: C.load_csv(spark, broken, "y"), lambda: C.load_csv(spark, broken, "y", multi_line=True), lambda: C.load_content(spark, 'x,y\n1,2\n"3\n4",5\n', "y")):
        with pytest.raises(ParseError) as e:
            load()
        assert (e.value.line, e.value.column, e.value.value) == (3, "x", "3\n4")
    assert C.preview(spark, broken)["rows"] == [["1", "2"], ["3\n4", "5"]]
    with pytest.raises(InconsistentRow) as e:
        C.load_csv(spark, write(tmp_path, 'x,y\n1,2\n1,"2,3",4\n', "c.csv"), "y")
    assert (e.value.line, e.value.expected, e.value.found) == (3, 2, 3)


def test_rows_keep_their_order_over_many_tasks(spark, tmp_path):
    path = write(tmp_path, "x,y\n" + "".join(f"{i},{2 * i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = C.load_csv(spark, path, "y").df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20_000 and all(r.row_id == r.x and r.y == 2 * r.x for r in rows)


def test_a_line_end_at_the_end_of_a_cell_is_no_number(load):
    with pytest.raises(ParseError) as e:
        load('x,y\n"3\n",1\n', "y")
    assert e.value.value == "3\n"


def test_folder_of_unequal_files(spark, tmp_path):
    """Rows are numbered by file name, whatever order tasks read the files in; errors name the file and its line."""
    (tmp_path / "d").mkdir()
    sizes, n = {"a.csv": 5, "b.csv": 3000, "c.csv": 1}, 0
    for name, size in sizes.items():
        (tmp_path / "d" / name).write_text("x,y\n" + "".join(f"{n + i},{i}\n" for i in range(size)))
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = C.load_csv(spark, str(tmp_path / "d"), "y").df.collect()
        (tmp_path / "d" / "b.csv").write_text("x,y\n" + "1,1\n" * 2000 + "1,no\n")
        (tmp_path / "d" / "c.csv").write_text("x,y\nno,1\n")
        with pytest.raises(ParseError) as e:
            C.load_csv(spark, str(tmp_path / "d"), "y")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == n and all(r.row_id == r.x for r in rows)
    assert e.value.file.endswith("b.csv") and e.value.line == 2002
