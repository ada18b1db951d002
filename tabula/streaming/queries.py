"""The query surface over streams: where and select as running queries, and time windows with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.plans.expr import Predicate
from tabula.plans.query import Aggregate, aggregate_column, group_by


def stream_select(stream: DataFrame, keys: Sequence[str], aggs: Sequence[Aggregate], where: Predicate | None = None) -> DataFrame:
    """Running groups over a stream, for complete or update output."""
    return group_by(stream, keys, aggs, where=where)


def windowed_select(
    stream: DataFrame, time: str, length: str, keys: Sequence[str], aggs: Sequence[Aggregate],
    lateness: str = "10 minutes", slide: str | None = None, where: Predicate | None = None,
) -> DataFrame:
    """Groups by time window and keys; rows later than `lateness` behind the newest are dropped, so state stays bounded."""
    rows = stream if where is None else stream.filter(where.compile(stream.schema))
    rows = rows.withWatermark(time, lateness)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = rows.groupBy(window.alias("window"), *keys).agg(*[aggregate_column(rows, a) for a in aggs])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[f"`{a.name}`" for a in aggs])
