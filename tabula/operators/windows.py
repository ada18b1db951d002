"""Ranking and shifting windows.

With `partition_by` these are plain windows. Without it they run over the row order of the whole table, which no task
could hold: rows are numbered (see tabula.operators.ordering) and cut into blocks of at most BLOCK rows. A block gets
the rows around its edge that it needs, and what earlier blocks counted is carried over from one short row for each
block, a millionth of the table's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.operators.ordering import ROW, is_dense, number_rows
from tabula.plans.query import clean
from tabula.session import cut
from tabula.types import codec_of

#: Rows of a block at most, and at least where the table is so small that fewer blocks than cores would result.
BLOCK, LEAST_BLOCK = 1 << 20, 1 << 12


def _order(df: DataFrame, order: Sequence[Column] | None) -> list[Column]:
    if order:
        return list(order)
    if ROW not in df.columns:
        raise ValueError("the frame has no row order; attach one with tabula.frame.with_rows or give `order`")
    return [F.col(ROW).asc()]


def _numbered(df: DataFrame, order: Sequence[Column] | None) -> DataFrame:
    """`df` with `_n`, its place from 0; a dense row order is taken as it is."""
    if not order and is_dense(df):
        return df.withColumn("_n", F.col(ROW))
    return number_rows(df, _order(df, order), "_n", unique=not order)


def _block_rows(numbered: DataFrame, block: int | None) -> int:
    """Rows of a block: as asked for, else so many that every core gets some blocks."""
    if block is not None:
        return block
    most = numbered.agg(F.max("_n")).first()[0] or 0
    return min(BLOCK, max(LEAST_BLOCK, most // (4 * numbered.sparkSession.sparkContext.defaultParallelism) + 1))


def row_number(df: DataFrame, out: str = "row_number", order: Sequence[Column] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 1."""
    given, order = order, _order(df, order)
    if partition_by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order)).cast("long"))
    return _numbered(df, given).withColumn(out, F.col("_n") + 1).drop("_n")


def ranks(
    df: DataFrame, name: str, rank: str | None = "rank", dense: str | None = "dense_rank", order: Sequence[Column] | None = None,
    partition_by: Sequence[str] = (), block: int | None = None,
) -> DataFrame:
    """Both ranks of each row's run of equal values, nulls being equal, in one pass: the number of the run's first row
    (1, 1, 3 on sorted input) and the number of the run (1, 1, 2). A name of None leaves a column out."""
    given, order = order, _order(df, order)
    wanted = {rank: F.col("_start") + 1, dense: F.col("_kinds")}
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order)
        df = df.withColumn("_k", clean(df, name)).withColumn("_n", F.row_number().over(w).cast("long") - 1)
        df = df.withColumn("_new", (F.col("_n") == 0) | ~F.col("_k").eqNullSafe(F.lag("_k").over(w)))
        placed = _counted(df, w)
    else:
        numbered = _numbered(df, given).withColumn("_k", clean(df, name))
        block = _block_rows(numbered, block)
        last = F.col("_n") % block == block - 1
        own = F.floor(F.col("_n") / block).cast("long")
        spread = numbered.withColumn("_b", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
        w = Window.partitionBy("_b").orderBy("_n")
        flagged = spread.withColumn("_new", (F.col("_n") == 0) | ~F.col("_k").eqNullSafe(F.lag("_k").over(w)))
        placed = cut(_counted(flagged.filter(F.col("_b") == own), w))
        earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        blocks = placed.groupBy("_b").agg(F.max("_start").alias("_s"), F.max("_kinds").alias("_c"))
        carried = blocks.select(
            F.col("_b"), F.max("_s").over(earlier).alias("_before"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base")
        )
        placed = placed.join(F.broadcast(carried), "_b")
        wanted = {rank: F.coalesce("_start", "_before") + 1, dense: F.col("_base") + F.col("_kinds")}
    named = placed.withColumns({out: value for out, value in wanted.items() if out is not None})
    return named.drop("_b", "_n", "_k", "_new", "_start", "_kinds", "_before", "_base")


def _counted(flagged: DataFrame, w: Window) -> DataFrame:
    """The first row of each row's run (`_start`) and the runs so far (`_kinds`), inside a window."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumns({
        "_start": F.max(F.when(F.col("_new"), F.col("_n"))).over(upto), "_kinds": F.sum(F.col("_new").cast("long")).over(upto),
    })


def rank(
    df: DataFrame, name: str, out: str = "rank", order: Sequence[Column] | None = None, partition_by: Sequence[str] = (), block: int | None = None
) -> DataFrame:
    """Number of the first row of each run of equal values, nulls being equal: 1, 1, 3 on sorted input."""
    return ranks(df, name, out, None, order, partition_by, block)


def dense_rank(
    df: DataFrame, name: str, out: str = "dense_rank", order: Sequence[Column] | None = None, partition_by: Sequence[str] = (), block: int | None = None
) -> DataFrame:
    """Number of the run of equal values: 1, 1, 2 on sorted input."""
    return ranks(df, name, None, out, order, partition_by, block)


def _shift(df: DataFrame, name: str, offset: int, default: Any, out: str, back: bool, order, partition_by, block: int | None) -> DataFrame:
    if offset < 0:
        raise ValueError("offset must not be negative")
    schema_field = df.schema[name]
    found = codec_of(schema_field)
    if default is not None and found is not None and not isinstance(default, (int, float)):
        default = found.encode(default)
    given, order = order, _order(df, order)
    value = clean(df, name)
    fallback = F.lit(default).cast(schema_field.dataType)
    metadata = schema_field.metadata or {}
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order)
        moved = (F.lag if back else F.lead)(value, offset, default).over(w).cast(schema_field.dataType)
        return df.withColumn(out, moved).withMetadata(out, metadata)
    numbered = _numbered(df, given).withColumn("_v", value)
    block = _block_rows(numbered, block)
    own = F.floor(F.col("_n") / block).cast("long")
    reach = F.floor((F.col("_n") + (offset if back else -offset)) / block).cast("long")
    blocks = F.sequence(own, reach) if back else F.reverse(F.sequence(reach, own))
    spread = numbered.withColumn("_b", F.explode(blocks))
    w = Window.partitionBy("_b").orderBy("_n")
    moved = (F.lag if back else F.lead)("_v", offset).over(w)
    beside = (F.lag if back else F.lead)("_n", offset).over(w)
    shifted = spread.withColumn("_there", beside).withColumn(out, F.when(F.col("_there").isNull(), fallback).otherwise(moved))
    return shifted.filter(F.col("_b") == own).drop("_b", "_n", "_v", "_there").withMetadata(out, metadata)


def lag(
    df: DataFrame, name: str, offset: int = 1, default: Any = None, out: str = "lag", order: Sequence[Column] | None = None,
    partition_by: Sequence[str] = (), block: int | None = None,
) -> DataFrame:
    """The value `offset` rows back, else the default; a null found there stays null."""
    return _shift(df, name, offset, default, out, True, order, partition_by, block)


def lead(
    df: DataFrame, name: str, offset: int = 1, default: Any = None, out: str = "lead", order: Sequence[Column] | None = None,
    partition_by: Sequence[str] = (), block: int | None = None,
) -> DataFrame:
    """The value `offset` rows ahead, else the default; a null found there stays null."""
    return _shift(df, name, offset, default, out, False, order, partition_by, block)
