"""Tables: DataFrames whose rows may carry an order in the hidden column `_row`.

DataFrames are unordered; operations that depend on the physical order of rows (stable sorts, windows without a key,
first appearances) read it from `_row`, which `with_rows` attaches once at ingest.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.operators.ordering import ROW, densely_numbered, number_rows

KINDS = {
    "i64": T.LongType(),
    "f64": T.DoubleType(),
    "bool": T.BooleanType(),
    "sym": T.StringType(),
    "str": T.StringType(),
}


def with_rows(df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Attach `_row`: dense numbers from 0 in the given order, or increasing numbers in the order of reading."""
    if order:
        return number_rows(df, order, ROW)
    return df.withColumn(ROW, F.monotonically_increasing_id())


def without_rows(df: DataFrame) -> DataFrame:
    return df.drop(ROW)


def field(name: str, kind: str) -> T.StructField:
    """A column of kind i64, f64, bool, sym or str; a symbol is a string that says so in its metadata."""
    if kind not in KINDS:
        raise ValueError(f"unknown column kind {kind!r}")
    metadata = {"logical": "sym"} if kind == "sym" else {}
    return T.StructField(name, KINDS[kind], kind != "bool", metadata)


def table(spark: SparkSession, columns: Sequence[tuple[str, str, Iterable]], rows: bool = True) -> DataFrame:
    """A frame from (name, kind, values) in order. None is null, in a boolean column false; NaN is null."""
    names = [name for name, _, _ in columns]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    clean = []
    for _, kind, values in columns:
        if kind == "bool":
            clean.append([bool(v) for v in values])
        elif kind == "f64":
            clean.append([None if v is None or v != v else float(v) for v in values])
        elif kind == "i64":
            clean.append([None if v is None else int(v) for v in values])
        else:
            clean.append([None if v is None else str(v) for v in values])
    if len({len(v) for v in clean}) > 1:
        raise ValueError("columns differ in length")
    schema = T.StructType([field(name, kind) for name, kind, _ in columns])
    data = [(*values, n) for n, values in enumerate(zip(*clean))]
    schema.add(T.StructField(ROW, T.LongType(), False))
    df = spark.createDataFrame(data, schema)
    return df if rows else df.drop(ROW)


def array_column(spark: SparkSession, name: str, kind: str, values: np.ndarray | pa.Array) -> DataFrame:
    """A one-column frame with row order from a numpy or Arrow array, which never becomes Python objects.

    An Arrow null is null; NaN is null in an f64 column. Numbers are cast to the kind; one that does not fit is an error.
    """
    data = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)
    kinds = {"i64": pa.int64(), "f64": pa.float64(), "bool": pa.bool_(), "sym": pa.string(), "str": pa.string()}
    if kind not in kinds:
        raise ValueError(f"unknown column kind {kind!r}")
    data = pc.cast(data, kinds[kind])
    if kind == "f64":
        data = pc.if_else(pc.is_nan(data), pa.scalar(None, pa.float64()), data)
    if kind == "bool":
        data = pc.fill_null(data, False)
    schema = T.StructType([field(name, kind), T.StructField(ROW, T.LongType(), False)])
    return spark.createDataFrame(pa.table({name: data, ROW: pa.array(np.arange(len(data)))}), schema)


def columns(df: DataFrame) -> list[str]:
    """The visible columns."""
    return [c for c in df.columns if c != ROW]


def ncols(df: DataFrame) -> int:
    return len(columns(df))


def nrows(df: DataFrame) -> int:
    return df.count()


def col_idx(df: DataFrame, name: str) -> int:
    """The first position of a column, -1 if there is none."""
    found = columns(df)
    return found.index(name) if name in found else -1


def col_name(df: DataFrame, index: int) -> str:
    if not 0 <= index < ncols(df):
        raise IndexError(index)
    return columns(df)[index]


def column(df: DataFrame, name: str) -> DataFrame | None:
    """One column as a frame that keeps the row order, None if there is none."""
    if col_idx(df, name) < 0:
        return None
    return df.select(name, *([ROW] if ROW in df.columns else []))


def column_by_idx(df: DataFrame, index: int) -> DataFrame:
    return column(df, col_name(df, index))


def slice_rows(df: DataFrame, offset: int, length: int) -> DataFrame:
    """Rows offset to offset + length - 1 in the row order; the slice is numbered from 0. Row numbers with gaps are
    made dense first."""
    part = densely_numbered(df).filter(F.col(ROW).between(offset, offset + length - 1))
    return part.withColumn(ROW, F.col(ROW) - offset)


def null_free(df: DataFrame) -> DataFrame:
    """`df` with NaN as null in every floating column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) for c in floating}) if floating else df
