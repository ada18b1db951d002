"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tabula", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` keys use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` where the cluster names one.

    Only on a local master, as in tests, a folder of our own is named where nothing is set; elsewhere that is an error.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


#: Short rows that a task of a loop's joins and aggregations gets.
TASK_ROWS = 400_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions of about TASK_ROWS rows, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


@contextmanager
def shuffled_for(spark: SparkSession, rows: int) -> Iterator[int]:
    """Shuffles of what is computed inside have parts_for(rows) partitions, which are not joined again: otherwise adaptive
    execution makes about one for each core of however many rows."""
    parts = parts_for(spark, rows)
    keys = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield parts
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which `sweep` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/tabula/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, path: str, *measures: Column) -> dict:
    """Write `df` as Parquet, and the values of the named aggregates `measures`, taken while writing."""
    seen = Observation()
    df.observe(seen, *measures).write.parquet(path)
    return seen.get


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and continue from the file: no recomputation after a loss, and
    the planner knows the size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, where it is still there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_mark(spark: SparkSession) -> int:
    """A place in the list of scratch tables, for `release`."""
    return len(_SCRATCH.setdefault(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, mark: int) -> None:
    """Delete the scratch tables named since `mark`. What still reads them, being lazy, can't be computed afterwards."""
    paths = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    for path in paths[mark:]:
        drop_path(spark, path)
    del paths[mark:]


def sweep(spark: SparkSession) -> int:
    """Delete the scratch tables that this application wrote, and return how many. Results that still read them, which
    are lazy, can't be computed afterwards: call it when the results are stored."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_path(spark, path)
    return len(paths)
