import math

from pyspark.sql import functions as F

from tabula.functions import elementwise as el
from tests.helpers import make, rows


def pair(spark, kind, a, b):
    return make(spark, a=(kind, a), b=(kind, b))


def apply(df, f):
    return [r[0] for r in rows(df.withColumn("out", f(F.col("a"), F.col("b"))), "out")]


def test_arithmetic_with_nulls(spark):
    df = pair(spark, "i64", [1, None, 3], [10, 20, 30])
    assert apply(df, el.i64_add) == [11, None, 33]
    assert apply(df, el.i64_sub) == [-9, None, -27] and apply(df, el.i64_mul) == [10, None, 90]
    f = pair(spark, "f64", [1.0, None, 3.0], [0.5, 1.0, 0.0])
    assert apply(f, el.f64_add) == [1.5, None, 3.0] and apply(f, el.f64_div) == [2.0, None, None]
    assert apply(f, el.f64_sub) == [0.5, None, 3.0] and apply(f, el.f64_mul) == [0.5, None, 0.0]


def test_division_gives_doubles(spark):
    assert apply(pair(spark, "i64", [10, 20], [0, 4]), el.i64_div) == [None, 5.0]


def test_unary(spark):
    df = pair(spark, "i64", [1, None, -(2**63)], [-10, None, 30])
    assert apply(df, lambda a, b: el.i64_neg(b)) == [10, None, -30]
    assert apply(df, lambda a, b: el.i64_abs(a)) == [1, None, -(2**63)]
    f = spark.createDataFrame([(-1.5, 0.0), (math.nan, 1.0)], "a double, b double")
    assert [r[0] for r in f.select(el.f64_abs(F.col("a"))).collect()] == [1.5, None]
    assert [r[0] for r in f.select(el.f64_neg(F.col("a"))).collect()] == [1.5, None]


def test_wrapping_add(spark):
    df = pair(spark, "i64", [2**63 - 1, -(2**63), 5], [1, -1, None])
    assert apply(df, el.parallel_i64_add) == [-(2**63), 2**63 - 1, None]


def test_comparisons(spark):
    df = pair(spark, "i64", [1, None, 3], [1, 2, None])
    assert apply(df, el.i64_eq) == [True, False, False] and apply(df, el.i64_ne) == [False, False, False]
    f = spark.createDataFrame([(1.0, 1.0), (math.nan, 2.0), (3.0, math.nan)], "a double, b double")
    for test, want in ((el.f64_eq, [True, False, False]), (el.f64_ge, [True, False, False]), (el.f64_gt, [False] * 3), (el.f64_le, [True, False, False]), (el.f64_lt, [False] * 3), (el.f64_ne, [False] * 3)):
        assert [r[0] for r in f.select(test(F.col("a"), F.col("b"))).collect()] == want
    for test, want in ((el.i64_lt, [False] * 3), (el.i64_le, [True, False, False]), (el.i64_gt, [False] * 3), (el.i64_ge, [True, False, False])):
        assert apply(df, test) == want


def test_hashes(spark):
    df = spark.createDataFrame([(0.0, -0.0, 1, 2)], "a double, b double, i long, j long")
    a, b, i, j = map(F.col, "abij")
    row = df.select(
        el.hash_f64(a) == el.hash_f64(b), el.hash_combine(i, j) == el.hash_combine(j, i), el.hash_i64(i) == el.hash_i64(i), el.hash_row(i, j) == el.hash_combine(i, j)
    ).first()
    assert tuple(row) == (True, False, True, True)
