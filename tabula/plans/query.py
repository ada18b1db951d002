"""Queries: where, select, group_by and pivot over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.operators.ordering import ROW
from tabula.plans.expr import Predicate
from tabula.types import encoded

AGGREGATES = ("sum", "count", "avg", "min", "max")


@dataclass(frozen=True)
class Aggregate:
    """One of AGGREGATES over a column; `out` names the result, by default like sum-Qty."""

    agg: str
    column: str
    out: str | None = None

    def __post_init__(self) -> None:
        if self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg!r}")

    @property
    def name(self) -> str:
        return self.out or f"{self.agg}-{self.column}"

    def named(self, out: str) -> Aggregate:
        return Aggregate(self.agg, self.column, out)


def sum_(column: str, out: str | None = None) -> Aggregate:
    return Aggregate("sum", column, out)


def count(column: str, out: str | None = None) -> Aggregate:
    return Aggregate("count", column, out)


def avg(column: str, out: str | None = None) -> Aggregate:
    return Aggregate("avg", column, out)


def min_(column: str, out: str | None = None) -> Aggregate:
    return Aggregate("min", column, out)


def max_(column: str, out: str | None = None) -> Aggregate:
    return Aggregate("max", column, out)


def _is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    column = F.col(f"`{name}`")
    return F.nanvl(column, F.lit(None)) if _is_floating(df.schema[name].dataType) else column


def wrapping_sum(column: Column) -> Column:
    """A 64-bit sum that wraps around instead of failing on overflow."""
    around = F.lit(Decimal(2**64))
    total = F.pmod(F.sum(column.cast("decimal(28,0)")), around)
    return F.when(total >= F.lit(Decimal(2**63)), total - around).otherwise(total).cast("long")


def aggregate_column(df: DataFrame, item: Aggregate, zero: bool = True, wrap: bool = False) -> Column:
    """The aggregate as a column; `zero`: a sum over no values is 0 instead of null; `wrap`: see wrapping_sum."""
    schema_field = df.schema[item.column]
    column = clean(df, item.column)
    if item.agg == "count":
        return F.count(column).alias(item.name)
    if isinstance(schema_field.dataType, (T.StringType, T.BooleanType)):
        raise TypeError(f"{item.agg} does not apply to the {schema_field.dataType.simpleString()} column {item.column}")
    if item.agg in ("min", "max"):
        return (F.min if item.agg == "min" else F.max)(column).alias(item.name, metadata=schema_field.metadata or {})
    number = encoded(column, schema_field)
    if item.agg == "avg":
        return F.avg(number).alias(item.name)
    total = wrapping_sum(number) if wrap else F.sum(number)
    if not zero:
        return total.alias(item.name)
    nothing = F.lit(0.0) if _is_floating(schema_field.dataType) else F.lit(0)
    return F.coalesce(total, nothing).alias(item.name)


def where(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows for which the predicate holds; order, types and logical types stay."""
    return df.filter(predicate.compile(df.schema))


def mask(df: DataFrame, predicate: Predicate, name: str = "mask") -> DataFrame:
    """The predicate as a column that is never null."""
    return df.withColumn(name, F.coalesce(predicate.compile(df.schema), F.lit(False)))


def filter_rows(df: DataFrame, name: str = "mask") -> DataFrame:
    """Rows whose mask column holds, without the mask."""
    return df.filter(F.col(name)).drop(name)


def group_by(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Aggregate | tuple[str, str, str] | dict] = (),
    where: Predicate | None = None, n_threads: int | None = None, wrap: bool = False,
) -> DataFrame:
    """Group by at least one key. Null keys form a group, NaN keys too and with the nulls.

    `aggs`: Aggregates, (agg, column, out) triples, or dicts with these keys. `where` filters in the same stage.
    `n_threads` is accepted and ignored: partitions decide.
    """
    if not keys:
        raise ValueError("at least one key is needed; use the scalar aggregates for a whole table")
    items = [_as_aggregate(a) for a in aggs]
    df = df if where is None else df.filter(where.compile(df.schema))
    grouping = [clean(df, k).alias(k, metadata=df.schema[k].metadata or {}) for k in keys]
    if not items:
        return df.select(*grouping).distinct()
    return df.groupBy(*grouping).agg(*[aggregate_column(df, a, wrap=wrap) for a in items])


def parallel_group_by(df: DataFrame, keys: Sequence[str], aggs: Sequence[Any] = (), n_threads: int = 4, where: Predicate | None = None) -> DataFrame:
    """group_by; Spark is parallel by itself."""
    return group_by(df, keys, aggs, where=where)


def _as_aggregate(item: Any) -> Aggregate:
    if isinstance(item, Aggregate):
        return item
    if isinstance(item, dict):
        return Aggregate(item["agg"], item["col"], item.get("out"))
    return Aggregate(*item)


def select(df: DataFrame, *items: str | Aggregate) -> DataFrame:
    """Names are group keys, aggregates are computed: ``select(trades, "Symbol", sum_("Qty"))``."""
    return group_by(df, [i for i in items if isinstance(i, str)], [i for i in items if not isinstance(i, str)])


#: The column of a null pivot value, and the most pivot columns.
NULL_COLUMN, MOST_COLUMNS = "__null__", 10_000


def pivot(df: DataFrame, row: str, column: str, value: str, agg: str, columns: Sequence[Any] | None = None) -> DataFrame:
    """Cross-tabulation: one row for each `row` value, one column for each `column` value, in the order of first
    appearance where the frame has a row order, else sorted. Pairs that do not occur are null; a pair whose values are
    all null counts 0 and is null otherwise."""
    item = Aggregate(agg, value, "cell")
    heads = F.coalesce(clean(df, column).cast("string"), F.lit(NULL_COLUMN))
    shaped = df.withColumn("_head", heads)
    if columns is None:
        first = F.min(ROW) if ROW in df.columns else F.min("_head")
        found = shaped.groupBy("_head").agg(first.alias("first")).orderBy("first").limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} pivot columns")
        names = [r["_head"] for r in found]
    else:
        names = [NULL_COLUMN if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in columns]
    key = clean(df, row).alias(row, metadata=df.schema[row].metadata or {})
    return shaped.groupBy(key).pivot("_head", names).agg(aggregate_column(df, item, zero=False))


@dataclass(frozen=True)
class Query:
    """A query that can be inspected before it runs: keys and aggregates over a filtered table."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    aggs: tuple[Aggregate, ...] = ()
    predicate: Predicate | None = None

    def referenced_columns(self) -> list[str]:
        """Every column the query reads, the predicate's included, in the table's order."""
        used = {*self.keys, *(a.column for a in self.aggs), *self.predicate_columns()}
        return [c for c in self.df.columns if c in used]

    def predicate_columns(self) -> set[str]:
        return self.predicate.columns() if self.predicate is not None else set()

    def project(self) -> DataFrame:
        """The table narrowed to the columns that are read."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.referenced_columns()])

    def run(self) -> DataFrame:
        return group_by(self.df, self.keys, self.aggs, where=self.predicate)

    def analyze(self) -> dict[str, Any]:
        return {
            "type": "select", "n-rows": self.df.count(), "n-cols-referenced": len(self.referenced_columns()),
            "n-cols-total": len([c for c in self.df.columns if c != ROW]), "has-predicate": self.predicate is not None,
            "n-keys": len(self.keys), "n-aggs": len(self.aggs),
        }

    def explain(self) -> str:
        return self.run()._jdf.queryExecution().explainString(
            self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
