"""Graphs over edge tables: nodes 0 to n - 1, every node in every result.

Iterative algorithms are loops of joins and aggregations; each round is written to the shared checkpoint folder, so
plans stay short and lost executors cost one round. Only counts and convergence flags reach the driver.
"""

from __future__ import annotations

import mmap
import tempfile
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.operators.components import linked_components
from tabula.operators.ordering import ROW, number_rows
from tabula.session import cut, parts_for, shuffled_for

#: Edges within reach of the start up to which the one sequential algorithm, depth-first order, is run in one task: they
#: take 8 bytes each in a temporary file of that task.
SEQUENTIAL_EDGES = 1_000_000_000
#: Rounds of a search after which its parts are made one again.
MERGE_ROUNDS = 8


class Graph:
    """Directed edges (src, dst, weight, place); parallel edges are kept, and place is the order of insertion."""

    def __init__(self, edges: DataFrame, n_nodes: int, n_edges: int | None = None) -> None:
        self.edges, self.n_nodes, self._n_edges = edges, n_nodes, n_edges
        self.spark = edges.sparkSession

    def nodes(self) -> DataFrame:
        return self.spark.range(self.n_nodes).withColumnRenamed("id", "node")

    def n_edges(self) -> int:
        if self._n_edges is None:
            self._n_edges = self.edges.count()
        return self._n_edges


def build_graph(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, n_nodes: int | None = None) -> Graph:
    """Edges with a null end are dropped; negative ids are an error. n_nodes is the largest id + 1 unless given."""
    weights = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    place = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    edges = df.select(
        F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"),
        F.nanvl(weights, F.lit(None)).alias("weight"), place.alias("place"),
    ).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    bounds = edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if bounds["low"] is not None and bounds["low"] < 0:
        raise ValueError("node ids must not be negative")
    largest = -1 if bounds["high"] is None else bounds["high"]
    if n_nodes is not None and largest >= n_nodes:
        raise ValueError(f"node {largest} is beyond n_nodes")
    return Graph(edges, largest + 1 if n_nodes is None else n_nodes, bounds["n"])


def _counts(graph: Graph, end: str, out: str) -> DataFrame:
    counted = graph.edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return graph.nodes().join(counted, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias(out))


def degree(graph: Graph) -> DataFrame:
    """(node, degree): outgoing edges."""
    return _counts(graph, "src", "degree")


def in_degree(graph: Graph) -> DataFrame:
    """(node, in_degree): incoming edges."""
    return _counts(graph, "dst", "in_degree")


def neighbors(graph: Graph, node: int) -> DataFrame:
    """(target, weight, place) of a node's outgoing edges; place is their order, an edge without weight weighs 1."""
    return graph.edges.filter(F.col("src") == node).select(
        F.col("dst").alias("target"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "place"
    )


def _beside(graph: Graph, found: DataFrame) -> DataFrame:
    """All nodes with what was `found` for some, in partitions of a bounded number of nodes."""
    parts = parts_for(graph.spark, graph.n_nodes)
    return graph.nodes().repartition(parts, "node").join(found.repartition(parts, "node"), "node", "left")


def pagerank(graph: Graph, iters: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after `iters` rounds; ranks sum to 1, what dangling nodes hold is spread over all nodes.

    Links lie in partitions by source and ranks by node, so that a round shuffles only what the nodes are sent.
    """
    n = graph.n_nodes
    if n == 0:
        return graph.nodes().withColumn("rank", F.lit(0.0))
    with shuffled_for(graph.spark, max(graph.n_edges(), n)) as parts:
        many = graph.edges.repartition(parts, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("many"))
        many = cut(many)
        out = many.groupBy("src").agg(F.sum("many").alias("out"))
        flow = cut(many.join(out, "src").select("src", "dst", (F.col("many") / F.col("out")).alias("part")))
        leads = out.select(F.col("src").alias("node"), F.lit(True).alias("leads"))
        base = cut(graph.nodes().repartition(parts, "node").join(leads, "node", "left").select("node", F.col("leads").isNull().alias("dangling")))
        ranks = base.withColumn("rank", F.lit(1.0 / n))
        for _ in range(iters):
            spare = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("spare"))
            sent = flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(
                F.sum(F.col("rank") * F.col("part")).alias("got")
            )
            level = F.lit((1 - damping) / n) + damping * F.col("spare") / n
            ranks = (
                base.join(sent, "node", "left").join(F.broadcast(spare))
                .select("node", "dangling", (level + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
            )
            ranks = cut(ranks)
    return ranks.select("node", "rank")


def _shortest(links: DataFrame, start: DataFrame, rows: int, most: int) -> DataFrame:
    """(node, distance) of all nodes that `links` (src, dst, weight) lead to from `start` (node, distance).

    Nodes whose distance fell relax their links until none falls; more than `most` rounds are an error. Links and
    distances lie in partitions by node, so that a round shuffles only its offers. A round writes only the distances
    that fell; they are folded into one table every MERGE_ROUNDS rounds.
    """
    spark = links.sparkSession

    def least(found: DataFrame) -> DataFrame:
        return found.groupBy("node").agg(F.min("distance").alias("distance"))

    with shuffled_for(spark, rows) as parts:
        links = cut(links.repartition(parts, "src").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        edge = found = cut(start.repartition(parts, "node"))
        fell: list[DataFrame] = []
        rounds = 0
        while not edge.isEmpty():
            if rounds > most:
                raise ValueError("negative cycle")
            rounds += 1
            offers = edge.join(links, edge["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(
                F.min(edge["distance"] + F.col("weight")).alias("offer")
            )
            held = offers.join(found, "node", "left")
            if fell:
                recent = least(reduce(DataFrame.unionByName, fell)).withColumnRenamed("distance", "recent")
                held = held.join(recent, "node", "left").withColumn("distance", F.least("distance", "recent"))
            edge = cut(held.filter("distance IS NULL OR offer < distance").select("node", F.col("offer").alias("distance")))
            fell.append(edge)
            if rounds % MERGE_ROUNDS == 0:
                found, fell = cut(least(reduce(DataFrame.unionByName, fell, found))), []
        return cut(least(reduce(DataFrame.unionByName, fell, found)))


def _reached(graph: Graph, start: int) -> DataFrame:
    """(node, distance) in hops of the nodes that can be reached."""
    links = graph.edges.select("src", "dst", F.lit(1).cast("long").alias("weight"))
    first = graph.nodes().filter(F.col("node") == start).withColumn("distance", F.lit(0).cast("long"))
    return _shortest(links, first, graph.n_edges(), graph.n_nodes)


def bfs(graph: Graph, start: int) -> DataFrame:
    """(node, distance) in hops, null where a node is not reached; a start outside the graph reaches nothing."""
    return _beside(graph, _reached(graph, start))


def dijkstra(graph: Graph, start: int) -> DataFrame:
    """(node, distance) of the shortest weighted paths, null where a node is not reached.

    Edges without weight weigh 1 in a graph without weights and lead nowhere in one with weights. A negative cycle is an
    error after as many rounds as there are nodes.
    """
    weighted = not graph.edges.filter(F.col("weight").isNotNull()).isEmpty()
    links = graph.edges.withColumn("weight", F.col("weight") if weighted else F.lit(1.0)).filter("weight IS NOT NULL")
    first = graph.nodes().filter(F.col("node") == start).withColumn("distance", F.lit(0.0))
    return _beside(graph, _shortest(links, first, graph.n_edges(), graph.n_nodes))


def connected_components(graph: Graph) -> DataFrame:
    """(node, component): weak components, named by their smallest node."""
    with shuffled_for(graph.spark, graph.n_edges()):
        linked = linked_components(graph.edges, "src", "dst")
    return _beside(graph, linked).select("node", F.coalesce("component", "node").alias("component"))


def _depth_first(batches: Iterator[pa.RecordBatch], start: int, n_edges: int) -> Iterator[pa.RecordBatch]:
    """(node, order) from (place, node, value): an edge's place among all edges by source, its source and its target; for
    every node a row of place -1 with the number of its edges. The rows come in any order.

    Memory holds five numbers for each node. The edges' targets lie in a file, as numbers of nodes in sorted order.
    """
    with tempfile.TemporaryFile() as file:
        file.truncate(max(8 * n_edges, 8))
        with mmap.mmap(file.fileno(), 0) as held:
            targets = np.frombuffer(held, np.int64)
            nodes, counts = [], []
            for batch in batches:
                place, node, value = (column.to_numpy() for column in batch.columns)
                at = place >= 0
                targets[place[at]] = value[at]
                nodes.append(node[~at])
                counts.append(value[~at])
            heads, counts = np.concatenate(nodes), np.concatenate(counts)
            sort = np.argsort(heads)
            heads, counts = heads[sort], counts[sort]
            ends = np.cumsum(counts)
            for chunk in range(0, n_edges, 1 << 20):
                part = targets[chunk : min(chunk + (1 << 20), n_edges)]
                part[:] = np.searchsorted(heads, part)
            del nodes, sort
            cursors = memoryview(ends - counts)
            ends, order = memoryview(ends), np.full(len(heads), -1, np.int64)
            onward, orders = memoryview(targets), memoryview(order)
            stack, n = array("q", [int(np.searchsorted(heads, start))]), 1
            orders[stack[0]] = 0
            while stack:
                node = stack[-1]
                at, end = cursors[node], ends[node]
                while at < end:
                    to = onward[at]
                    at += 1
                    if orders[to] < 0:
                        orders[to] = n
                        n += 1
                        stack.append(to)
                        break
                else:
                    stack.pop()
                cursors[node] = at
            onward.release()
            del onward, targets, part
    for at in range(0, len(heads), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(heads[at : at + (1 << 16)]), pa.array(order[at : at + (1 << 16)])], ["node", "order"])


def dfs(graph: Graph, start: int) -> DataFrame:
    """(node, order): preorder of a depth-first search that takes edges in insertion order, null where not reached.

    The order is sequential by nature. A distributed search finds what can be reached from `start`, and the edges from
    there on are sorted and numbered in parallel; one task then walks them from a file, with a few numbers for each node
    in memory. Beyond SEQUENTIAL_EDGES edges within reach this is an error.
    """
    if not 0 <= start < graph.n_nodes:
        return graph.nodes().withColumn("order", F.lit(None).cast("long"))
    within = _reached(graph, start).select("node")
    edges = number_rows(
        graph.edges.select("src", "dst", "place").join(within.select(F.col("node").alias("src")), "src", "left_semi"),
        [F.col("src"), F.col("place")], "at", unique=True,
    )
    n_edges = edges.count()
    if n_edges > SEQUENTIAL_EDGES:
        raise ValueError(f"depth-first order needs at most {SEQUENTIAL_EDGES} edges within reach of the start")
    counts = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    nodes = cut(within.join(counts, "node", "left").select(F.lit(-1).cast("long").alias("at"), "node", F.coalesce("n", F.lit(0)).alias("n")))
    rows = edges.select("at", F.col("src").alias("node"), F.col("dst").alias("n")).unionByName(nodes).coalesce(1)
    found = rows.mapInArrow(lambda batches: _depth_first(batches, start, n_edges), "node long, order long")
    return _beside(graph, found)


def ranked_neighbors(graph: Graph, most: int) -> DataFrame:
    """(src, dst, weight, place, nth): the heaviest `most` edges of every node."""
    order = Window.partitionBy("src").orderBy(F.desc_nulls_last("weight"), "place")
    return graph.edges.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
