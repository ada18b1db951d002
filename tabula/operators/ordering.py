"""Stable sorts and global row numbers that stay distributed.

A frame that keeps its row order carries the hidden column ``_row`` (see tabula.frame). Numbering all rows of a table
does not gather them into one task: the sorted rows are written once, each with its partition and its place there, and
the few partition sizes turn the places into numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.session import cut

ROW = "_row"


def sort_column(df: DataFrame, name: str, direction: str = "asc") -> Column:
    """Order by a column: nulls first ascending and last descending; a floating null or NaN sorts as the largest value.

    Any direction but "asc" is descending.
    """
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        column = F.coalesce(column, F.lit(float("nan")))
    return column.asc() if direction == "asc" else column.desc()


def order_columns(df: DataFrame, keys: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort keys, then the row order where the frame has one, so that the sort is stable."""
    columns = [sort_column(df, name, direction) for name, direction in keys]
    return columns + ([F.col(ROW).asc()] if ROW in df.columns else [])


def number_rows(df: DataFrame, order: Sequence[Column], name: str, unique: bool = False) -> DataFrame:
    """`df` with a column of consecutive numbers from 0 in the given order.

    The range-sorted rows are cut off at the shared checkpoint folder, so that partitions and numbers agree. Unless the
    order is `unique`, rows that tie in it are ordered by a hash of their values and then by where they were read, so
    that a range partition never has to hold all rows of one key. One short row for each partition is broadcast.
    """
    if not unique:
        plain = [f"`{f.name}`" for f in df.schema if isinstance(f.dataType, T.AtomicType) and f.dataType.typeName() != "variant"]
        df = df.withColumns({"_hash": F.xxhash64(*plain) if plain else F.lit(0), "_read": F.monotonically_increasing_id()})
        order = [*order, F.col("_hash"), F.col("_read")]
    placed = cut(df.orderBy(*order).drop("_hash", "_read").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), part == F.col("_part"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = numbered.withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")
    return out.withMetadata(name, {"dense": True}) if name == ROW else out


def running_before(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each row in a unique order, 0 for the first.

    The rows are range-sorted and stay in their partitions; one sum for each partition is carried over to the next.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    here = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.sum("_n").over(before).alias("_start"))
    inside = placed.withColumn("_here", F.sum(value).over(here))
    joined = inside.join(F.broadcast(sums), "_part")
    total = F.coalesce("_start", F.lit(0)) + F.coalesce("_here", F.lit(0))
    return joined.withColumn(out, total).drop("_at", "_part", "_start", "_here")


def is_dense(df: DataFrame) -> bool:
    """Whether `_row` counts from 0 without gaps. Only a row order that number_rows made is looked at: filters keep its
    mark but leave gaps."""
    if ROW not in df.columns or not (df.schema[ROW].metadata or {}).get("dense"):
        return False
    row = df.agg(F.count(ROW).alias("n"), F.min(ROW).alias("low"), F.max(ROW).alias("high")).first()
    return row["n"] == 0 or (row["low"] == 0 and row["high"] == row["n"] - 1)


def densely_numbered(df: DataFrame) -> DataFrame:
    """A frame with a row order as it is where its numbers are dense, else numbered anew in that order."""
    if is_dense(df):
        return df
    if ROW not in df.columns:
        raise ValueError("the frame has no row order; attach one with tabula.frame.with_rows")
    return number_rows(df.withColumnRenamed(ROW, "_old"), [F.col("_old")], ROW).drop("_old")


def sort_table(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Stable sort by [(column, "asc" or "desc"), ...]. A frame with a row order is numbered anew in sorted order."""
    order = order_columns(df, keys)
    if ROW not in df.columns:
        return df.orderBy(*order)
    return number_rows(df.withColumnRenamed(ROW, "_old"), [*order[:-1], F.col("_old").asc()], ROW, unique=True).drop("_old")


def sort_index(df: DataFrame, name: str, direction: str = "asc") -> DataFrame:
    return sort_index_by(df, [(name, direction)])


def sort_index_by(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """(position, row): the permutation that sorts the frame, for a frame with a row order."""
    if ROW not in df.columns:
        raise ValueError("the frame has no row order; attach one with tabula.frame.with_rows")
    numbered = number_rows(df, order_columns(df, keys), "position", unique=True)
    return numbered.select("position", F.col(ROW).alias("row"))


def gather(df: DataFrame, index: DataFrame, position: str = "position", row: str = "row") -> DataFrame:
    """The rows of `df` that `index` names, in its order; an index may repeat or leave out rows."""
    wanted = index.select(F.col(position).alias("_pos"), F.col(row).alias(ROW))
    return df.join(wanted, ROW).drop(ROW).withColumnRenamed("_pos", ROW)
