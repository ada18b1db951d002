"""Batch-wise processing: fixed-size Arrow batches through a function, inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_ROWS = 1024


def batches(stream: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows`, the last of a partition shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in stream:
        while len(batch):
            part = batch.slice(0, rows - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == rows:
                yield _one(held)
                held, n = [], 0
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str, rows: int = BATCH_ROWS
) -> DataFrame:
    """`function` over batches of at most `rows` rows of each partition."""
    return df.mapInArrow(lambda stream: map(function, batches(stream, rows)), schema)


def batch_count(df: DataFrame, rows: int = BATCH_ROWS) -> int:
    """How many batches map_batches makes of `df` as it is partitioned now."""
    counted = map_batches(df, lambda b: pa.RecordBatch.from_pydict({"n": [1]}), "n long", rows)
    return counted.count()
