"""Element-wise arithmetic, comparisons and hashes over columns.

Null in, null out; NaN is null. Division gives a double, and null for a zero divisor. Integer overflow is an error
unless `wrap` is asked for. Comparisons with null or NaN are false.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MIN, I64_MAX = -(2**63), 2**63 - 1


def _real(x: Column) -> Column:
    return F.nanvl(x, F.lit(None))


def i64_neg(a: Column) -> Column:
    return -a


def i64_abs(a: Column) -> Column:
    """The smallest integer has no positive counterpart and stays."""
    return F.when(a == F.lit(I64_MIN), a).otherwise(F.abs(F.when(a != F.lit(I64_MIN), a)))


def i64_add(a: Column, b: Column, wrap: bool = False) -> Column:
    return _wrapped(_wide(a) + _wide(b)) if wrap else a + b


def i64_sub(a: Column, b: Column) -> Column:
    return a - b


def i64_mul(a: Column, b: Column) -> Column:
    return a * b


def i64_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f64_neg(a: Column) -> Column:
    return -_real(a)


def f64_abs(a: Column) -> Column:
    return F.abs(_real(a))


def f64_add(a: Column, b: Column) -> Column:
    return _real(a + b)


def f64_sub(a: Column, b: Column) -> Column:
    return _real(a - b)


def f64_mul(a: Column, b: Column) -> Column:
    return _real(a * b)


def f64_div(a: Column, b: Column) -> Column:
    return _real(F.try_divide(a, b))


def _wide(a: Column) -> Column:
    return a.cast("decimal(20,0)")


def _wrapped(total: Column) -> Column:
    """A sum of two 64-bit integers, brought back into their range."""
    around = F.lit(Decimal(2**64))
    return F.when(total > F.lit(I64_MAX), total - around).when(total < F.lit(I64_MIN), total + around).otherwise(total).cast("long")


def parallel_i64_add(a: Column, b: Column) -> Column:
    """Addition that wraps around."""
    return i64_add(a, b, wrap=True)


def _i64_compare(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def i64_eq(a: Column, b: Column) -> Column:
    return _i64_compare(a == b)


def i64_ne(a: Column, b: Column) -> Column:
    return _i64_compare(a != b)


def i64_lt(a: Column, b: Column) -> Column:
    return _i64_compare(a < b)


def i64_le(a: Column, b: Column) -> Column:
    return _i64_compare(a <= b)


def i64_gt(a: Column, b: Column) -> Column:
    return _i64_compare(a > b)


def i64_ge(a: Column, b: Column) -> Column:
    return _i64_compare(a >= b)


def f64_eq(a: Column, b: Column) -> Column:
    return i64_eq(_real(a), _real(b))


def f64_ne(a: Column, b: Column) -> Column:
    return i64_ne(_real(a), _real(b))


def f64_lt(a: Column, b: Column) -> Column:
    return i64_lt(_real(a), _real(b))


def f64_le(a: Column, b: Column) -> Column:
    return i64_le(_real(a), _real(b))


def f64_gt(a: Column, b: Column) -> Column:
    return i64_gt(_real(a), _real(b))


def f64_ge(a: Column, b: Column) -> Column:
    return i64_ge(_real(a), _real(b))


def hash_i64(a: Column) -> Column:
    return F.xxhash64(a)


def hash_f64(a: Column) -> Column:
    """Both zeros hash alike, NaN like null."""
    return F.xxhash64(_real(a) + F.lit(0.0))


def hash_combine(a: Column, b: Column) -> Column:
    """Depends on the order of the two."""
    return F.xxhash64(a, b)


def hash_row(*columns: Column) -> Column:
    return F.xxhash64(*columns)
