import pytest

from tabula.operators.ordering import ROW
from tabula.sources import csvio
from tabula.sources.store import load_table, save_table
from tests.helpers import make, rows


def kinds(df):
    return [f.dataType.simpleString() for f in df.schema if f.name != ROW]


def test_inference(spark):
    df = csvio.read_csv(spark, "Symbol,Qty,Price\nAAPL,100,150.5\nGOOG,200,140.25\n")
    assert kinds(df) == ["string", "bigint", "double"] and rows(df) == [("AAPL", 100, 150.5), ("GOOG", 200, 140.25)]
    df = csvio.read_csv(spark, "100,200\n300,400\n", header=False)
    assert df.columns[:2] == ["col0", "col1"] and rows(df) == [(100, 200), (300, 400)]
    assert rows(csvio.read_csv(spark, "A,B\n")) == [] and kinds(csvio.read_csv(spark, "A,B\n")) == ["string", "string"]
    assert rows(csvio.read_csv(spark, "Name,Score\nAlice,100\nBob,\n")) == [("Alice", 100), ("Bob", None)]
    assert rows(csvio.read_csv(spark, "Flag\nTRUE\nFALSE\ntrue\nfalse\n")) == [(True,), (False,), (True,), (False,)]
    assert kinds(csvio.read_csv(spark, "Val\n100\n3.14\n200\n")) == ["double"]
    assert rows(csvio.read_csv(spark, "x\nInf\n-Inf\n1.5\nnan\n")) == [(float("inf"),), (float("-inf"),), (1.5,), (None,)]


def test_shapes_and_overrides(spark):
    assert rows(csvio.read_csv(spark, "a,b\n1\n2,3,4\n")) == [(1, None), (2, 3)]
    df = csvio.read_csv(spark, "a,b\n1,2\n", types={1: "f64"})
    assert rows(df) == [("1", 2.0)]
    assert kinds(csvio.read_csv(spark, "a\ntrue\n1\n")) == ["string"]
    assert rows(csvio.read_csv(spark, "a;b\n'x;y';2\n", delimiter=";", quote="'")) == [("x;y", 2)]
    assert rows(csvio.read_csv(spark, 'a\n"say ""hi"",\nthere"\n')) == [('say "hi",\nthere',)]
    assert rows(csvio.read_csv(spark, "a\r\n1\r\n")) == [(1,)]
    assert rows(csvio.read_csv(spark, "a|1|2", end_of_line="|")) == [(1,), (2,)]
    with pytest.raises(Exception):
        rows(csvio.read_csv(spark, "a\n" + "1\n" * 100 + "oops\n"))
    with pytest.raises(Exception):
        csvio.read_csv(spark, 'a\n"x"y\n', strict=True)


def test_write_and_read_back(spark, tmp_path):
    df = make(spark, s=("sym", ["a", "b", None]), q=("i64", [10, 20, 30]))
    text = csvio.write_csv(df)
    assert text == "s,q\na,10\nb,20\n,30\n"
    assert rows(csvio.read_csv(spark, text)) == [("a", 10), ("b", 20), (None, 30)]
    assert csvio.write_csv(make(spark, s=("str", ['x,"y"'])), force_quote=True) == '"s"\n"x,""y"""\n'
    path = csvio.write_csv_files(df, str(tmp_path / "c"))
    assert sorted(rows(csvio.read_csv_files(spark, path)), key=repr) == sorted([("a", 10), ("b", 20), (None, 30)], key=repr)


def test_store(spark, tmp_path):
    df = make(spark, s=("sym", ["a", None]), q=("i64", [1, None]), p=("f64", [None, 2.5]), f=("bool", [True, False]), t=("str", ["", None]))
    again = load_table(spark, save_table(df, str(tmp_path / "t")))
    assert rows(again) == rows(df) and again.schema["s"].metadata == {"logical": "sym"}
    empty = make(spark, s=("sym", []), q=("i64", []))
    assert kinds(load_table(spark, save_table(empty, str(tmp_path / "e")))) == ["string", "bigint"]
    with pytest.raises(ValueError):
        save_table(empty.select(ROW), str(tmp_path / "n"))
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "missing"))


def test_records(tmp_path, spark):
    text = 'a;"b;""c"""\n\n"x\ny";\n'
    assert csvio.parse_csv(text, delimiter=";") == [["a", 'b;"c"'], ["x\ny", ""]]
    assert csvio.parse_csv(csvio.format_csv([["a", None], ['q"', "x,y"]])) == [["a", ""], ['q"', "x,y"]]
    with pytest.raises(Exception):
        csvio.parse_csv('"x"y', strict=True)


def test_files_without_header_and_with_order(tmp_path, spark):
    for name, body in (("b.csv", "3,4,5\n"), ("a.csv", "1\n2,x\n")):
        (tmp_path / name).write_text(body)
    df = csvio.read_csv_files(spark, str(tmp_path), header=False, rows=True)
    assert rows(df) == [(1, None, None), (2, "x", None), (3, "4", 5)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "p.csv").write_text("k|1|2")
    assert sorted(rows(csvio.read_csv_files(spark, str(tmp_path / "c"), end_of_line="|"))) == [(1,), (2,)]


def test_row_order_of_files_needs_no_sort_of_lines(tmp_path, spark):
    """Files of several blocks: numbers are dense and in order, and no line is moved to get one."""
    for name, low in (("b.csv", 3000), ("a.csv", 0), ("c.csv", 6000)):
        (tmp_path / name).write_text("k\n" + "".join(f"{n}\n" for n in range(low, low + 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = csvio.read_csv_files(spark, str(tmp_path), rows=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r[ROW], r["k"]) for r in df.collect()) == [(n, n) for n in range(9000)]
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "rangepartitioning" not in plan and plan.count("Sort [") <= 1 and "Scan ExistingRDD" not in plan
