"""Scalar aggregates over a column of a whole table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.plans.expr import Predicate
from tabula.plans.query import Aggregate, aggregate_column, clean


def reduce(df: DataFrame, *items: Aggregate) -> DataFrame:
    """One row with the aggregates: a sum over no values is 0, other aggregates are null then, counts 0."""
    return df.agg(*[aggregate_column(df, i) for i in items])


def _value(df: DataFrame, agg: str, name: str) -> Any:
    return reduce(df, Aggregate(agg, name, "value")).first()["value"]


def sum_of(df: DataFrame, name: str) -> Any:
    return _value(df, "sum", name)


def min_of(df: DataFrame, name: str) -> Any:
    return _value(df, "min", name)


def max_of(df: DataFrame, name: str) -> Any:
    return _value(df, "max", name)


def avg_of(df: DataFrame, name: str) -> float | None:
    return _value(df, "avg", name)


def count_non_null(df: DataFrame, name: str) -> int:
    return df.agg(F.count(clean(df, name)).alias("n")).first()["n"]


def filter_count(df: DataFrame, predicate: Predicate) -> int:
    """How many rows the predicate holds for."""
    return df.agg(F.count_if(predicate.compile(df.schema)).alias("n")).first()["n"]
