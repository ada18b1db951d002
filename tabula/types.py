"""Logical types: domain values over a long or double column, carried in column metadata.

Dates, instants and datetimes are native Spark types. Other types are codecs: an order-preserving encoding to long or
double, named in the metadata of the column, so comparison, sorting, grouping and min/max work on the encoded value and
only the edges encode and decode.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.operators.ordering import ROW

EPOCH = dt.date(1970, 1, 1)
_UTC_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_PLAIN_EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Codec:
    """physical is "i64" or "f64"; native is the Spark type that holds decoded values, if there is one."""

    physical: str
    cls: type
    encode: Callable[[Any], int | float]
    decode: Callable[[int | float], Any]
    native: T.DataType | None = None


_REGISTRY: dict[str, Codec] = {}


def register_type(tag: str, physical: str, cls: type, encode: Callable, decode: Callable, native: T.DataType | None = None) -> None:
    if physical not in ("i64", "f64"):
        raise ValueError("physical must be i64 or f64")
    _REGISTRY[tag] = Codec(physical, cls, encode, decode, native)


def lookup(tag: str) -> Codec | None:
    return _REGISTRY.get(tag)


def codec(tag: str) -> Codec:
    if tag not in _REGISTRY:
        raise KeyError(f"unknown logical type {tag!r}")
    return _REGISTRY[tag]


def physical(tag: str) -> str:
    return codec(tag).physical


def encode(tag: str, value: Any) -> int | float | None:
    return None if value is None else codec(tag).encode(value)


def decode(tag: str, value: int | float | None) -> Any:
    return None if value is None else codec(tag).decode(value)


_MILLI = dt.timedelta(milliseconds=1)
register_type("date", "i64", dt.date, lambda d: (d - EPOCH).days, lambda n: EPOCH + dt.timedelta(days=n), T.DateType())
register_type("instant", "i64", dt.datetime, lambda t: (t - _UTC_EPOCH) // _MILLI, lambda n: _UTC_EPOCH + n * _MILLI, T.TimestampType())
register_type("datetime", "i64", dt.datetime, lambda t: (t - _PLAIN_EPOCH) // _MILLI, lambda n: _PLAIN_EPOCH + n * _MILLI, T.TimestampNTZType())
register_type("date-millis", "i64", dt.datetime, lambda t: (t - _UTC_EPOCH) // _MILLI, lambda n: _UTC_EPOCH + n * _MILLI, T.TimestampType())
#: Nanoseconds, which Spark's intervals cannot hold; whole ones as integers, or timedeltas.
register_type(
    "duration", "i64", dt.timedelta,
    lambda d: d if isinstance(d, int) else (d // dt.timedelta(microseconds=1)) * 1000,
    lambda n: dt.timedelta(microseconds=n // 1000),
)


def logical_of(schema_field: T.StructField) -> str | None:
    """The logical type of a column: from its metadata, else from its native type."""
    tag = schema_field.metadata.get("logical") if schema_field.metadata else None
    if tag:
        return tag
    for kind, name in ((T.DateType, "date"), (T.TimestampType, "instant"), (T.TimestampNTZType, "datetime")):
        if isinstance(schema_field.dataType, kind):
            return name
    return None


def codec_of(schema_field: T.StructField) -> Codec | None:
    """The codec of a column that holds encoded values."""
    tag = schema_field.metadata.get("logical") if schema_field.metadata else None
    return _REGISTRY.get(tag) if tag and tag != "sym" else None


def with_logical(column: Column, name: str, tag: str | None) -> Column:
    """The column under a name and a logical type; None clears the type."""
    return column.alias(name, metadata={"logical": tag} if tag else {})


def typed_column(spark: SparkSession, name: str, tag: str, values: Iterable) -> DataFrame:
    """A one-column frame of a logical type: native where Spark has the type, else encoded."""
    found = codec(tag)
    if found.native is not None:
        data = [(v, n) for n, v in enumerate(values)]
        schema_field = T.StructField(name, found.native)
    else:
        data = [(encode(tag, v), n) for n, v in enumerate(values)]
        schema_field = T.StructField(name, T.LongType() if found.physical == "i64" else T.DoubleType(), True, {"logical": tag})
    return spark.createDataFrame(data, T.StructType([schema_field, T.StructField(ROW, T.LongType(), False)]))


def decoded(df: DataFrame, name: str) -> list:
    """The values of a column as domain values, in row order; for small results."""
    tag = logical_of(df.schema[name])
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    values = [r[0] for r in ordered.select(F.col(f"`{name}`")).collect()]
    return [decode(tag, v) for v in values] if codec_of(df.schema[name]) else values


def encoded(column: Column, schema_field: T.StructField) -> Column:
    """The number behind a native date or time column, for sums and averages; other columns as they are."""
    if isinstance(schema_field.dataType, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(schema_field.dataType, T.TimestampType):
        return F.unix_millis(column)
    if isinstance(schema_field.dataType, T.TimestampNTZType):
        return F.unix_millis(F.to_utc_timestamp(column.cast("timestamp"), F.current_timezone()))
    return column
