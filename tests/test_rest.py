import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabula.frame import with_rows
from tabula.operators import batches
from tabula.operators.selection import DEAD, LIVE, MIXED, live_by_block, selection_all, selection_none
from tabula.plans import catalogue
from tabula.plans.expr import c
from tabula.plans.query import count, sum_
from tabula.streaming.queries import stream_select, windowed_select
from tests.helpers import make, rows


def test_selection():
    assert selection_all(1500).popcount() == 1500 and selection_none(10).popcount() == 0
    some = selection_all(5000)
    for row in (0, 1, 1024, 2000, 4095, 4999):
        some = some.set_row(row, False)
    assert some.popcount() == 4994 and some.block_popcount(0) == 1022 and some.block_flag(0) == MIXED
    assert selection_all(100).set_row(5, False).popcount() == 99
    assert some.set_row(0, True).row_live(0) and not some.row_live(1)
    assert selection_none(2000).block_flag(1) == DEAD and selection_all(2000).block_flag(1) == LIVE
    with pytest.raises(IndexError):
        some.set_row(5000, True)


def test_selection_applies(spark):
    df = make(spark, v=("i64", [1, 2, 3]))
    assert rows(selection_all(3).set_row(1, False).apply(df)) == [(1,), (3,)]
    assert rows(selection_none(3).set_row(1, True).apply(df)) == [(2,)] and rows(selection_none(3).apply(df)) == []


def test_blocks(spark):
    df = with_rows(spark.range(3000).withColumnRenamed("id", "v"), [F.col("v")])
    found = [tuple(r) for r in live_by_block(df, c("v") >= 1500).orderBy("block").collect()]
    assert found == [(0, 1024, 0, "dead", 0), (1, 1024, 548, "mixed", 0), (2, 952, 952, "live", 548)]


def test_batches(spark):
    df = spark.range(0, 5000, 1, 1)
    sizes = batches.map_batches(df, lambda b: pa.RecordBatch.from_pydict({"n": [len(b)]}), "n long").collect()
    assert [r["n"] for r in sizes] == [1024] * 4 + [904]
    assert batches.batch_count(df) == 5 and batches.batch_count(spark.range(0)) == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql(
        "SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS k, id AS v FROM range(30)"
    ).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k long, v long").parquet(str(src))
    for name, df, mode in (
        ("running", stream_select(stream, ["k"], [sum_("v", "s")], where=c("v") >= 10), "complete"),
        ("windowed", windowed_select(stream, "ts", "10 minutes", ["k"], [count("v", "n")]), "update"),
    ):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(tuple(r) for r in spark.table("running").collect()) == [(0, 190), (1, 200)]
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == 30 and spark.table("windowed").count() == 6


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(found) and set(sql) <= set(found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue_agrees_with_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = catalogue.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    norm = lambda v: round(float(v), 6) if isinstance(v, float) else v
    left = sorted((tuple(norm(v) for v in r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert left == sorted((tuple(norm(v) for v in r) for r in want.fetchall()), key=repr)
