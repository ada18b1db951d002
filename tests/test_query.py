import pytest
from pyspark.sql import functions as F

from tabula.operators import reduce
from tabula.plans.expr import c, either, every
from tabula.plans.query import Aggregate, Query, avg, count, group_by, max_, min_, parallel_group_by, pivot, select, sum_, where
from tests.helpers import make, rows, unordered


def trades(spark):
    return make(spark, Symbol=("sym", ["a", "b", "a", "b", "a"]), Qty=("i64", [10, 20, 30, 40, 50]))


def test_select_sum_names_its_column(spark):
    out = select(trades(spark), "Symbol", sum_("Qty"))
    assert out.columns == ["Symbol", "sum-Qty"]
    assert unordered(out) == [("a", 90), ("b", 60)]
    assert out.schema["Symbol"].metadata == {"logical": "sym"}


def test_two_keys(spark):
    data = [("US", "buy", 100), ("US", "sell", 200), ("CA", "buy", 150), ("CA", "sell", 300), ("MX", "buy", 175)]
    r, s, q = zip(*data)
    out = select(make(spark, Region=("sym", r), Side=("sym", s), Qty=("i64", q)), "Region", "Side", sum_("Qty"))
    assert unordered(out) == sorted(data, key=repr)


def test_five_aggregates(spark):
    df = make(spark, k=("sym", ["a", "a", "b", "b"]), v=("i64", [10, 20, 30, 40]))
    out = select(df, "k", sum_("v"), count("v"), min_("v"), max_("v"), avg("v"))
    assert unordered(out) == [("a", 30, 2, 10, 20, 15.0), ("b", 70, 2, 30, 40, 35.0)]


def test_keys_only_are_distinct(spark):
    assert unordered(select(trades(spark), "Symbol")) == [("a",), ("b",)]


def test_empty_table_keeps_schema(spark):
    out = select(make(spark, k=("i64", []), v=("i64", [])), "k", sum_("v"))
    assert out.columns == ["k", "sum-v"] and rows(out) == []


def test_null_values_and_keys(spark):
    assert unordered(select(make(spark, k=("i64", [1, 1, 1]), v=("i64", [10, None, 30])), "k", sum_("v"), count("v"))) == [(1, 40, 2)]
    out = select(make(spark, k=("i64", [1, None, 1]), v=("i64", [10, 20, 30])), "k", sum_("v"))
    assert set(rows(out)) == {(None, 20), (1, 40)}


def test_all_null_group(spark):
    df = make(spark, k=("i64", [1, 1, 2, 2]), v=("i64", [None, None, 5, 9]))
    assert unordered(select(df, "k", min_("v"), max_("v"), avg("v"), sum_("v"))) == [(1, None, None, None, 0), (2, 5, 9, 7.0, 14)]


def test_scalar_sums_of_nothing(spark):
    assert reduce.sum_of(make(spark, v=("i64", [None, None, None])), "v") == 0
    assert reduce.sum_of(make(spark, v=("f64", [None, float("nan")])), "v") == 0.0
    assert reduce.min_of(make(spark, v=("i64", [])), "v") is None
    assert reduce.max_of(make(spark, v=("i64", [3, None, 8])), "v") == 8
    assert reduce.avg_of(make(spark, v=("f64", [1.0, None, 2.0])), "v") == 1.5
    assert reduce.count_non_null(make(spark, v=("str", ["a", None, ""])), "v") == 2
    assert reduce.filter_count(trades(spark), c("Qty") > 20) == 3


def test_infinities_survive(spark):
    out = select(make(spark, k=("i64", [1, 1]), v=("f64", [float("inf"), None])), "k", min_("v"))
    assert rows(out) == [(1, float("inf"))]


def test_count_of_booleans_and_strings(spark):
    df = make(spark, k=("i64", [1, 1, 2]), b=("bool", [True, False, True]), s=("str", ["x", None, "y"]))
    assert unordered(select(df, "k", count("b"), count("s"))) == [(1, 2, 1), (2, 1, 1)]
    with pytest.raises(TypeError):
        select(df, "k", sum_("s"))


def test_large_key_is_one_group(spark):
    out = select(make(spark, k=("i64", [3558559446808474027] * 5), v=("i64", [1, 2, 3, 4, 5])), "k", sum_("v"))
    assert rows(out) == [(3558559446808474027, 15)]


def test_nan_and_zero_keys(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (0.0, 3), (-0.0, 4)], "k double, v long")
    assert set(rows(group_by(df, ["k"], [sum_("v", "s")]))) == {(None, 3), (0.0, 7)}


def test_where_comparisons(spark):
    df = make(spark, Qty=("i64", [50, 100, 150, 200]))
    assert rows(where(df, c("Qty") > 100)) == [(150,), (200,)]
    assert rows(where(df, c("Qty") >= 100)) == [(100,), (150,), (200,)]
    assert rows(where(df, c("Qty") <= 100)) == [(50,), (100,)]
    assert rows(where(make(spark, P=("f64", [1.0, 5.0, 10.0])), c("P") > 5)) == [(10.0,)]


def test_where_combined_then_select(spark):
    df = make(spark, Qty=("i64", [50, 150, 250, 150]), Price=("f64", [10, 20, 30, 60]))
    assert rows(where(df, every(c("Qty") > 100, c("Price") < 50)), "Qty") == [(150,), (250,)]
    df = make(spark, S=("sym", ["a", "b", "a", "b"]), Qty=("i64", [100, 50, 200, 300]))
    assert unordered(select(where(df, c("Qty") > 100), "S", sum_("Qty"))) == [("a", 200), ("b", 300)]


def test_negation_is_two_valued(spark):
    df = make(spark, Qty=("i64", [1, None, 9]))
    assert rows(where(df, ~(c("Qty") > 5))) == [(1,), (None,)]
    assert rows(where(df, c("Qty") != 1)) == [(9,)]
    assert rows(where(df, ~(c("Qty") != 1))) == [(1,), (None,)]
    assert rows(where(df, ~either(c("Qty") >= 0, c("Qty") < 0))) == [(None,)]
    assert rows(where(df, c("Qty").is_null())) == [(None,)]
    assert rows(where(df, ~c("Qty").is_null())) == [(1,), (9,)]


def test_nan_compares_false(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (9.0,)], "x double")
    assert sorted(r[0] for r in where(df, c("x") > 5).collect()) == [9.0]
    kept = [r[0] for r in where(df, ~(c("x") > 5)).collect()]
    assert len(kept) == 3 and 1.0 in kept
    assert where(df, c("x") == float("nan")).count() == 0


def test_literals(spark):
    assert rows(where(make(spark, Qty=("i64", [100, 101])), c("Qty") == 100.5)) == [(100,)]
    assert rows(where(make(spark, b=("bool", [True, False])), c("b") == True)) == [(True,)]  # noqa: E712
    with pytest.raises(TypeError):
        where(make(spark, s=("str", ["x"])), c("s") > "a")


def test_pushdown_survives_compilation(spark, tmp_path):
    make(spark, a=("i64", [1, 2]), b=("i64", [3, 4]), d=("f64", [1.0, 2.0])).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = Query(df, ("a",), (sum_("b"),), (c("d") > 1.0) & ~(c("b") > 9)).explain()
    assert "GreaterThan(d,1.0)" in plan and "LessThanOrEqual(b,9)" in plan
    assert "ReadSchema: struct<a:bigint,b:bigint,d:double>" in plan


def test_pivot(spark):
    df = make(spark, S=("sym", ["AAPL", "AAPL", "GOOG", "GOOG", "AAPL"]), Side=("sym", ["Buy", "Sell", "Buy", "Sell", "Buy"]), Q=("i64", [100, 200, 150, 300, 50]))
    out = pivot(df, "S", "Side", "Q", "sum")
    assert out.columns == ["S", "Buy", "Sell"] and unordered(out) == [("AAPL", 150, 200), ("GOOG", 150, 300)]
    missing = make(spark, r=("sym", ["x", "y"]), k=("sym", ["a", "b"]), v=("i64", [10, 20]))
    assert unordered(pivot(missing, "r", "k", "v", "sum")) == [("x", 10, None), ("y", None, 20)]


def test_pivot_of_nulls(spark):
    df = make(spark, r=("sym", ["a", "a", "b"]), k=("sym", ["x", "y", "x"]), v=("i64", [None, 2, 3]))
    assert unordered(pivot(df, "r", "k", "v", "sum")) == [("a", None, 2), ("b", 3, None)]
    assert unordered(pivot(df, "r", "k", "v", "count")) == [("a", 0, 1), ("b", 1, None)]
    big = make(spark, r=("i64", [1]), k=("sym", [None]), v=("i64", [2**60 + 1]))
    out = pivot(big, "r", "k", "v", "max")
    assert out.columns == ["r", "__null__"] and rows(out) == [(1, 2**60 + 1)]


def test_fused_where_equals_filter_then_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 20 != 0, F.col("id") % 20).alias("k"), (F.xxhash64("id") % 1000).alias("v"))
    a = group_by(df, ["k"], [sum_("v", "s"), count("v", "n")], where=c("v") > 500)
    b = group_by(where(df, c("v") > 500), ["k"], [sum_("v", "s"), count("v", "n")])
    assert set(rows(a)) == set(rows(b))
    assert set(rows(parallel_group_by(df, ["k"], [("sum", "v", "s")]))) == set(rows(group_by(df, ["k"], [{"agg": "sum", "col": "v", "out": "s"}])))


def test_wrapping_sum(spark):
    df = make(spark, k=("i64", [1, 1]), v=("i64", [2**63 - 1, 1]))
    assert rows(group_by(df, ["k"], [sum_("v", "s")], wrap=True)) == [(1, -(2**63))]


def test_errors(spark):
    with pytest.raises(ValueError):
        group_by(trades(spark), [], [sum_("Qty")])
    with pytest.raises(ValueError):
        Aggregate("median", "Qty")


def test_analyze(spark):
    df = make(spark, sym=("sym", ["a", "b", "a"]), qty=("i64", [1, 2, 3]))
    found = Query(df, ("sym",), (sum_("qty"),)).analyze()
    assert found == {"type": "select", "n-rows": 3, "n-cols-referenced": 2, "n-cols-total": 2, "has-predicate": False, "n-keys": 1, "n-aggs": 1}
    narrowed = Query(df, ("sym",), (), c("qty") > 1)
    assert narrowed.project().columns == ["sym", "qty"] and unordered(narrowed.run()) == [("a",), ("b",)]
