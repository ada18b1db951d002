"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.session import drop_path, scratch, shuffled_for, written

#: Edges of one node from which on it is joined apart, and how many such nodes there can be for each of the joins.
HOT_ROWS, MOST_HOT = 100_000, 20_000


def _signature() -> list[Column]:
    """Row count and an order-free checksum of an edge set, taken while it is written."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]


def _beside_least(rows: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """`rows` (u, v) with the m that `least` (u, m, n) has for u. Nodes of more than `hot` of the rows, which are few
    because their rows add up, are broadcast, so that the neighbours of none gather in one task."""
    heavy = least.filter(F.col("n") > hot)
    apart = rows.join(F.broadcast(heavy), "u")
    rest = rows.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(least.filter(F.col("n") <= hot), "u")
    return apart.unionByName(rest)


def _star_round(edges: DataFrame, rows: int, low_path: str, large_path: str) -> DataFrame:
    """One large-star and one small-star step over `rows` edges that point from the larger to the smaller node; what its
    joins read several times is written to the two paths."""
    spark, hot = edges.sparkSession, max(HOT_ROWS, rows // MOST_HOT)

    def least(found: DataFrame, path: str) -> DataFrame:
        low = found.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        low.select("u", F.least("u", "m").alias("m"), "n").write.parquet(path)
        return spark.read.schema(low.schema).parquet(path)

    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    low = least(edges.unionByName(back), f"{low_path}/large")
    large = _beside_least(back, low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large.write.parquet(large_path)
    large = spark.read.schema(edges.schema).parquet(large_path)
    root = least(large, f"{low_path}/small")
    hung = _beside_least(large, root, hot).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def linked_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Self loops, repeated edges and edges with a null end are ignored. Every round writes its edges to
    the shared folder and deletes those of the round before; the number of rounds grows with the logarithm of the
    longest path, and no neighbourhood is ever gathered into one row or one task.
    """
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    given = (
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    )
    path = scratch(spark, "edges")
    seen = written(given, path, *_signature())
    current = spark.read.schema(given.schema).parquet(path)
    while seen.get("n"):
        following = scratch(spark, "edges")
        with shuffled_for(spark, 2 * seen["n"]):
            helping = [scratch(spark, "least"), scratch(spark, "large")]
            now = written(_star_round(current, seen["n"], *helping), following, *_signature())
        for used in helping:
            drop_path(spark, used)
        drop_path(spark, path)
        path, current = following, spark.read.schema(given.schema).parquet(following)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
