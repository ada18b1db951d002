import random

import pytest
from pyspark.sql import functions as F

from tabula import session
from tabula.operators import components
from tabula.operators import graph as g
from tests.helpers import make


def build(spark, edges, weights=None, n=None):
    src, dst = zip(*edges) if edges else ((), ())
    cols = {"src": ("i64", src), "dst": ("i64", dst)}
    if weights:
        cols["weight"] = ("f64", weights)
    return g.build_graph(make(spark, **cols), weight="weight" if weights else None, n_nodes=n)


def values(df):
    return [r[1] for r in df.orderBy("node").collect()]


def test_degrees_and_neighbors(spark):
    x = build(spark, [(0, 1), (1, 2), (2, 3), (0, 2)])
    assert x.n_nodes == 4 and x.n_edges() == 4
    assert values(g.degree(x)) == [2, 1, 1, 0] and values(g.in_degree(x)) == [0, 1, 2, 1]
    y = build(spark, [(0, 2), (0, 1), (0, 3)], [20.0, 10.0, 30.0])
    assert [(r["target"], r["weight"]) for r in g.neighbors(y, 0).orderBy("place").collect()] == [(2, 20.0), (1, 10.0), (3, 30.0)]
    assert [r["weight"] for r in g.neighbors(x, 1).collect()] == [1.0]
    assert [r["dst"] for r in g.ranked_neighbors(y, 1).collect()] == [3]


def test_bfs(spark):
    assert values(g.bfs(build(spark, [(0, 1), (1, 2), (2, 3), (0, 2)]), 0)) == [0, 1, 1, 2]
    assert values(g.bfs(build(spark, [(0, 1)], n=4), 0)) == [0, 1, None, None]
    assert values(g.bfs(build(spark, [(0, 1)], n=2), 9)) == [None, None]


def test_dfs_follows_insertion_order(spark):
    x = build(spark, [(0, 2), (0, 1), (2, 3), (1, 3)], n=6)
    assert values(g.dfs(x, 0)) == [0, 3, 1, 2, None, None]
    assert values(g.dfs(x, 9)) == [None] * 6


def test_long_paths_survive_merging(spark, monkeypatch):
    monkeypatch.setattr(g, "MERGE_ROUNDS", 2)
    chain = [(n, n + 1) for n in range(6)] + [(0, 6)]
    assert values(g.bfs(build(spark, chain), 0)) == [*range(6), 1]
    assert values(g.dijkstra(build(spark, chain, [1.0] * 6 + [50.0]), 0)) == [float(n) for n in range(7)]
    assert values(g.dfs(build(spark, chain, n=9), 3)) == [None] * 3 + list(range(4)) + [None] * 2


def test_dfs_is_bounded_by_what_is_reached(spark, monkeypatch):
    monkeypatch.setattr(g, "SEQUENTIAL_EDGES", 2)
    edges = [(0, 1), (1, 2)] + [(n, n + 1) for n in range(5, 8)]
    assert values(g.dfs(build(spark, edges), 0))[:3] == [0, 1, 2]
    with pytest.raises(ValueError):
        g.dfs(build(spark, edges), 5)


def test_dfs_over_more_edges_than_five_million(spark):
    n = F.col("id")
    edges = spark.range(5_000_004).select((n % 2).alias("src"), F.when(n < 4, 5 - n).otherwise(n % 7).alias("dst"), n.alias("_row"))
    onward = {}
    for s, d in [(0, 5), (1, 4), (0, 3), (1, 2)] + [(k % 2, k % 7) for k in range(4, 18)]:
        onward.setdefault(s, []).append(d)
    order, stack = {}, [0]
    while stack:
        node = stack.pop()
        if node not in order:
            order[node] = len(order)
            stack += reversed(onward.get(node, []))
    assert values(g.dfs(g.build_graph(edges), 0)) == [order[v] for v in range(7)]


def test_dijkstra(spark):
    assert values(g.dijkstra(build(spark, [(0, 1), (1, 2), (0, 2)], [1.0, 1.0, 5.0]), 0)) == [0.0, 1.0, 2.0]
    assert values(g.dijkstra(build(spark, [(0, 1)], [1.0], n=3), 0)) == [0.0, 1.0, None]
    assert values(g.dijkstra(build(spark, [(0, 1), (1, 2)], [1.0, None]), 0)) == [0.0, 1.0, None]
    assert values(g.dijkstra(build(spark, [(0, 1), (1, 2)]), 0)) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        g.dijkstra(build(spark, [(0, 1), (1, 0)], [-1.0, -1.0]), 0)


def test_pagerank(spark):
    x = build(spark, [(0, 1), (1, 2), (2, 0), (0, 2), (1, 0)])
    assert sum(values(g.pagerank(x, 10))) == pytest.approx(1.0)
    assert values(g.pagerank(build(spark, [(0, 0)]), 5)) == pytest.approx([1.0])
    edges = [(0, 1), (0, 1), (0, 2), (3, 0)]
    rank, n = [0.25] * 4, 4
    for _ in range(6):
        dangling = sum(rank[v] for v in (1, 2)) / n
        base = 0.15 / n + 0.85 * dangling
        rank = [base + 0.85 * rank[3], base + 0.85 * rank[0] * 2 / 3, base + 0.85 * rank[0] / 3, base]
    assert values(g.pagerank(build(spark, edges), 6)) == pytest.approx(rank)


def test_components(spark):
    assert values(g.connected_components(build(spark, [(0, 1), (1, 2), (3, 4)]))) == [0, 0, 0, 3, 3]
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(n, n + 1) for n in range(60, 90)]
    label = list(range(120))
    for _ in range(120):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert values(g.connected_components(build(spark, edges, n=120))) == label


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """Tasks of the loops get a bounded number of rows, and a hub's neighbours are joined apart."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    monkeypatch.setattr(components, "HOT_ROWS", 50)
    x = build(spark, [(0, n) for n in range(1, 400)] + [(n, 700) for n in range(400, 500)] + [(n, n + 1) for n in range(600, 606)])
    label = [0] * 400 + [400] * 100 + list(range(500, 600)) + [600] * 7 + list(range(607, 700)) + [400]
    found = g.connected_components(x)
    assert ", 8), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() and values(found) == label
    assert g.pagerank(x, 1).rdd.getNumPartitions() == 8
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_bad_ids(spark):
    with pytest.raises(ValueError):
        build(spark, [(-1, 0)])
    with pytest.raises(ValueError):
        build(spark, [(0, 5)], n=3)
    assert build(spark, []).n_nodes == 0
