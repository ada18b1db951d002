"""Predicates as small expression trees, compiled to filters that Parquet scans can use.

Comparisons with null or NaN are false, and `~` is two-valued: it keeps the rows for which a comparison was false
because of a null. Negations are pushed to the comparisons, so the compiled column never wraps a comparison and stays
eligible for pushdown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.types import codec_of

_NEGATED = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "=": "!=", "!=": "="}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Every((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Any_((self, other))

    def __invert__(self) -> Predicate:
        return Inverse(self)

    def columns(self) -> set[str]:
        raise NotImplementedError

    def compile(self, schema: T.StructType, negated: bool = False) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    name: str
    op: str
    value: Any

    def columns(self) -> set[str]:
        return {self.name}

    def _literal(self, schema_field: T.StructField):
        value, kind = self.value, schema_field.dataType
        found = codec_of(schema_field)
        if found is not None and not isinstance(value, (int, float)) and value is not None:
            value = found.encode(value)
        if isinstance(kind, T.BooleanType):
            return bool(value)
        if isinstance(kind, T.IntegralType) and isinstance(value, float) and math.isfinite(value):
            return int(value)
        return value

    def compile(self, schema: T.StructType, negated: bool = False) -> Column:
        schema_field = schema[self.name]
        kind, value = schema_field.dataType, self._literal(schema_field)
        if isinstance(kind, (T.StringType, T.BooleanType)) and self.op not in ("=", "!="):
            raise TypeError(f"{self.op} does not apply to the {kind.simpleString()} column {self.name}")
        if value is None or isinstance(value, float) and math.isnan(value):
            return F.lit(negated)
        column, literal = F.col(f"`{self.name}`"), F.lit(value)
        op = _NEGATED[self.op] if negated else self.op
        test = {
            ">": column > literal, "<": column < literal, ">=": column >= literal, "<=": column <= literal,
            "=": column == literal, "!=": column != literal,
        }[op]
        floating = isinstance(kind, (T.DoubleType, T.FloatType))
        if not negated:
            return test & ~F.isnan(column) if floating else test
        test = test | column.isNull() if schema_field.nullable else test
        return test | F.isnan(column) if floating else test


@dataclass(frozen=True, eq=False)
class Missing(Predicate):
    """Null or NaN."""

    name: str

    def columns(self) -> set[str]:
        return {self.name}

    def compile(self, schema: T.StructType, negated: bool = False) -> Column:
        column = F.col(f"`{self.name}`")
        floating = isinstance(schema[self.name].dataType, (T.DoubleType, T.FloatType))
        if negated:
            return column.isNotNull() & ~F.isnan(column) if floating else column.isNotNull()
        return column.isNull() | F.isnan(column) if floating else column.isNull()


@dataclass(frozen=True, eq=False)
class Inverse(Predicate):
    inner: Predicate

    def columns(self) -> set[str]:
        return self.inner.columns()

    def compile(self, schema: T.StructType, negated: bool = False) -> Column:
        return self.inner.compile(schema, not negated)


@dataclass(frozen=True, eq=False)
class _Many(Predicate):
    parts: tuple[Predicate, ...]

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def _joined(self, schema: T.StructType, negated: bool, conjunction: bool) -> Column:
        out = F.lit(conjunction)
        for n, part in enumerate(self.parts):
            here = part.compile(schema, negated)
            out = here if n == 0 else out & here if conjunction else out | here
        return out


class Every(_Many):
    def compile(self, schema: T.StructType, negated: bool = False) -> Column:
        return self._joined(schema, negated, conjunction=not negated)


class Any_(_Many):
    def compile(self, schema: T.StructType, negated: bool = False) -> Column:
        return self._joined(schema, negated, conjunction=negated)


class Field:
    """A column name to compare: ``c("Qty") > 100``."""

    __hash__ = None

    def __init__(self, name: str) -> None:
        self.name = name

    def __gt__(self, value: Any) -> Predicate:
        return Compare(self.name, ">", value)

    def __lt__(self, value: Any) -> Predicate:
        return Compare(self.name, "<", value)

    def __ge__(self, value: Any) -> Predicate:
        return Compare(self.name, ">=", value)

    def __le__(self, value: Any) -> Predicate:
        return Compare(self.name, "<=", value)

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Compare(self.name, "=", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Compare(self.name, "!=", value)

    def is_null(self) -> Predicate:
        return Missing(self.name)


def c(name: str) -> Field:
    return Field(name)


def every(*parts: Predicate) -> Predicate:
    return Every(parts)


def either(*parts: Predicate) -> Predicate:
    return Any_(parts)
