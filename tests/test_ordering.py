import random

import pytest
from pyspark.sql import functions as F

from tabula import types
from tabula.frame import col_idx, col_name, column, ncols, slice_rows, table, with_rows
from tabula.operators import windows
from tabula.operators.ordering import ROW, gather, number_rows, sort_index, sort_index_by, sort_table
from tests.helpers import make, rows


def index(df):
    return [r["row"] for r in df.orderBy("position").collect()]


def test_sort_index(spark):
    df = make(spark, v=("i64", [30, 10, 20]))
    assert index(sort_index(df, "v")) == [1, 2, 0] and index(sort_index(df, "v", "desc")) == [0, 2, 1]
    assert index(sort_index(make(spark, v=("i64", [5, 5, 5])), "v", "desc")) == [0, 1, 2]
    mixed = make(spark, a=("i64", [1, 1, 2, 2]), b=("i64", [10, 20, 10, 20]))
    assert index(sort_index_by(mixed, [("a", "asc"), ("b", "desc")])) == [1, 0, 3, 2]


def test_null_order(spark):
    f = make(spark, v=("f64", [2.0, None, 1.0]))
    assert rows(sort_table(f, [("v", "asc")])) == [(1.0,), (2.0,), (None,)]
    assert rows(sort_table(f, [("v", "desc")])) == [(None,), (2.0,), (1.0,)]
    i = make(spark, v=("i64", [2, None, 1]))
    assert rows(sort_table(i, [("v", "asc")])) == [(None,), (1,), (2,)]
    assert rows(sort_table(i, [("v", "desc")])) == [(2,), (1,), (None,)]


def test_gather_follows_index(spark):
    df = make(spark, v=("str", ["x", "y", "z"]))
    picked = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "position long, row long")
    assert rows(gather(df, picked)) == [("z",), ("x",), ("z",)]


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.xxhash64("id"))
    out = number_rows(df, [F.col("k")], "n").orderBy("k").collect()
    assert [r["n"] for r in out] == list(range(1000))


def test_ranks(spark):
    df = make(spark, v=("i64", [10, 10, 20, 20, 30]))
    assert rows(windows.rank(df, "v"), "rank") == [(1,), (1,), (3,), (3,), (5,)]
    assert rows(windows.dense_rank(df, "v"), "dense_rank") == [(1,), (1,), (2,), (2,), (3,)]
    assert rows(windows.row_number(df), "row_number") == [(1,), (2,), (3,), (4,), (5,)]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_ranks_of_unsorted_runs(spark, block):
    df = make(spark, v=("i64", [10, 10, 20, 10, None, None]))
    assert [r[0] for r in rows(windows.rank(df, "v", block=block), "rank")] == [1, 1, 3, 4, 5, 5]
    assert [r[0] for r in rows(windows.dense_rank(df, "v", block=block), "dense_rank")] == [1, 1, 2, 3, 4, 4]


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_lag_lead_blocks(spark, block):
    rng = random.Random(block)
    values = [rng.choice([None, 1, 2, 3]) for _ in range(23)]
    df = make(spark, v=("i64", values))
    for offset in (0, 1, 3, 30):
        back = [-1 if n < offset else values[n - offset] for n in range(23)]
        ahead = [-1 if n + offset >= 23 else values[n + offset] for n in range(23)]
        assert [r[0] for r in rows(windows.lag(df, "v", offset, -1, block=block), "lag")] == back
        assert [r[0] for r in rows(windows.lead(df, "v", offset, -1, block=block), "lead")] == ahead


def test_lag_lead(spark):
    df = make(spark, v=("i64", [10, 20, 30, 40]))
    assert [r[0] for r in rows(windows.lag(df, "v"), "lag")] == [None, 10, 20, 30]
    assert [r[0] for r in rows(windows.lead(df, "v"), "lead")] == [20, 30, 40, None]
    assert [r[0] for r in rows(windows.lag(df, "v", 2, 0), "lag")] == [0, 0, 10, 20]
    with pytest.raises(ValueError):
        windows.lag(df.drop(ROW), "v")


def test_partitioned_windows(spark):
    df = make(spark, k=("sym", ["a", "b", "a", "b"]), v=("i64", [1, 5, 1, 6]))
    order = [F.col(ROW)]
    out = windows.rank(df, "v", order=order, partition_by=["k"])
    assert rows(out, "k", "rank") == [("a", 1), ("b", 1), ("a", 1), ("b", 2)]
    out = windows.lag(df, "v", 1, 0, order=order, partition_by=["k"])
    assert rows(out, "lag") == [(0,), (0,), (1,), (5,)]


def test_frame_accessors(spark):
    df = table(spark, [("a", "i64", [1, 2, 3]), ("b", "str", ["x", None, "z"])])
    assert ncols(df) == 2 and col_idx(df, "b") == 1 and col_idx(df, "zz") == -1 and column(df, "zz") is None
    assert col_name(df, 0) == "a" and rows(slice_rows(df, 1, 2)) == [(2, None), (3, "z")]
    with pytest.raises(IndexError):
        col_name(df, 2)
    with pytest.raises(ValueError):
        table(spark, [("a", "i64", [1]), ("b", "i64", [1, 2])])
    assert rows(with_rows(df.drop(ROW), [F.col("a").desc()]), "a") == [(3,), (2,), (1,)]


def test_boolean_columns_are_never_null(spark):
    df = table(spark, [("b", "bool", [True, None])])
    assert rows(df) == [(True,), (False,)] and not df.schema["b"].nullable


def test_types_through_windows(spark):
    import datetime as dt

    days = [dt.date(2020, 1, 1), dt.date(2020, 6, 15)]
    df = types.typed_column(spark, "d", "date", days)
    assert [r[0] for r in rows(windows.lag(df, "d", 1, dt.date(1999, 12, 31)), "lag")] == [dt.date(1999, 12, 31), days[0]]


def test_gaps_in_the_row_order_are_closed(spark):
    from tabula.frame import slice_rows, with_rows
    from tabula.operators.ordering import running_before
    from tabula.operators.selection import live_by_block
    from tabula.plans.expr import c

    df = with_rows(spark.range(0, 3000, 1, 5).withColumnRenamed("id", "v"))
    assert [r[0] for r in rows(slice_rows(df, 30, 10))] == list(range(30, 40))
    assert sorted(tuple(r) for r in live_by_block(df, c("v") >= 1500).collect())[1] == (1, 1024, 548, "mixed", 0)
    sums = running_before(spark.range(500).withColumnRenamed("id", "v"), [F.col("v")], "v", "s")
    assert {r["v"]: r["s"] for r in sums.collect()} == {v: v * (v - 1) // 2 for v in range(500)}


def test_both_ranks_in_one_pass(spark):
    from tabula.operators import windows

    df = make(spark, v=("f64", [10, 10, 20, None, float("nan"), 10]))
    for block in (None, 2):
        assert rows(windows.ranks(df, "v", block=block), "rank", "dense_rank") == [(1, 1), (1, 1), (3, 2), (4, 3), (4, 3), (6, 4)]


def test_plans_of_sorts_and_windows(spark):
    from tabula.plans.ordered import sort_plan, window_plan

    df = make(spark, a=("i64", [2, 1, 2]), b=("sym", ["x", "y", "z"]))
    planned = sort_plan(df, [("a", "asc")])
    assert planned.referenced_columns() == ["a"] and planned.project().columns == ["a", "_row"] and rows(planned.run(), "b") == [("y",), ("x",), ("z",)]
    assert planned.analyze() == {"type": "sort", "n-rows": 3, "n-cols-referenced": 1, "n-cols-total": 2}
    assert rows(window_plan(df, "lag", "a", out="l").run(), "l") == [(None,), (2,), (1,)]
    assert window_plan(df, "row_number").referenced_columns() == [] and window_plan(df, "rank", "a").analyze()["type"] == "window"
    with pytest.raises(ValueError):
        window_plan(df, "median", "a")


def test_arrays_become_columns(spark):
    import numpy as np
    import pyarrow as pa

    from tabula.frame import array_column

    assert rows(array_column(spark, "x", "f64", np.array([1.5, np.nan]))) == [(1.5,), (None,)]
    assert rows(array_column(spark, "x", "i64", pa.array([3, None], pa.int32()))) == [(3,), (None,)]
    assert rows(array_column(spark, "x", "bool", pa.array([True, None]))) == [(True,), (False,)]
    assert array_column(spark, "x", "sym", pa.array(["a"])).schema["x"].metadata == {"logical": "sym"}


def test_scratch_tables_are_swept(spark):
    import os

    from tabula.session import kept, scratch, sweep

    left = kept(spark.range(3), "swept")
    path = scratch(spark, "never-written")
    folder = os.path.dirname(path)
    assert left.count() == 3 and any(n.startswith("swept-") for n in os.listdir(folder))
    assert sweep(spark) >= 2 and not any(n.startswith("swept-") for n in os.listdir(folder)) and sweep(spark) == 0


def test_release_deletes_only_what_came_after_the_mark(spark):
    from tabula.session import kept, release, scratch_mark

    before = kept(spark.range(3), "before")
    mark = scratch_mark(spark)
    after = kept(spark.range(4), "after")
    release(spark, mark)
    assert before.count() == 3
    with pytest.raises(Exception):
        after.count()
