"""Helpers that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.session import kept, scratch

__all__ = ["kept", "scratch"]

#: A word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Tables of at most so many short rows (under 200 bytes each) are broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 50_000
#: Bytes in an Arrow batch, so that batches of long texts stay small.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes where they are not, because whole texts travel in them; the
    bound of rows stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key).rstrip("bB")
    if not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Words of `text`, 0 for null: every word with the blanks around it becomes one letter, and letters are counted."""
    around = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    marks = F.regexp_replace(F.regexp_replace(text, around, "w"), BLANKS, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def join_small(big: DataFrame, small: DataFrame, on, how: str, small_rows: int) -> DataFrame:
    """Join with `small`, whose rows were counted: broadcast below SMALL_ROWS, else by shuffle, where adaptive
    execution splits the partitions of hot keys."""
    return big.join(F.broadcast(small) if small_rows <= SMALL_ROWS else small, on, how)


#: Rows of one key from which on the key is joined apart.
HOT_ROWS = 10_000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with `table`, one row for each value of `on`, whose column `weight` says how many of `rows` have it.

    A table of few counted rows is broadcast. From a larger one only the keys of many rows are, a number that is bounded
    because their rows add up; all other keys are joined by shuffle, and none of those fills a task.
    """
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("rows")).first()
    if size["n"] <= SMALL_ROWS:
        return rows.join(F.broadcast(table.drop(weight)), on)
    hot = F.col(weight) > max(HOT_ROWS, 2 * size["rows"] // SMALL_ROWS)
    heavy, light = table.filter(hot).drop(weight), table.filter(~hot).drop(weight)
    apart = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return apart.unionByName(rest)


def learnable(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether labels of this document may be learned: crc32 of its id as text leaves another remainder. Null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus != remainder, F.lit(False))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, label: str, per_class: int, classes: int = 1000) -> DataFrame:
    """About `per_class` rows of each label (all, if fewer), chosen by a hash of `key`, so that reruns agree.

    Of more than `classes` distinct labels, a documented bound on what is learned, the most frequent are sampled. The
    sample is never larger than `classes` times about `per_class` rows.
    """
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_many"))
    known = kept(counts.orderBy(F.desc("_many"), "_label").limit(classes), "sample-classes")
    share = F.lit(float(per_class)) / F.col("_many")
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(known), F.col(label) == F.col("_label")).filter(place < share).drop("_label", "_many")
