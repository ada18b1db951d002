"""The graph queries over every row, against brute force on a small fixture and against their SQL."""

import heapq

import duckdb
import pytest

from tabula.plans.catalogue import ORACLE_SQL, QUERIES

ORDERS = [(7, 1), (601, 1), (602, 2), (1203, 3), (5, 3)]  # beyond order 600 and off every fifth
LINES = [(7, 1), (7, 2), (601, 2), (602, 2), (602, 2), (1203, 9), (5, 4), (5, 9)]
C, O = 4, 1204
NODES = C + O + 10
EDGES = {(c, C + o) for o, c in ORDERS} | {(C + o, C + O + s) for o, s in LINES}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def found(spark, folder, name):
    got = {r[0]: r[1] for r in QUERIES[name](spark, folder).collect()}
    assert set(got) == set(range(NODES))
    return got


def shortest(weigh):
    best, heap = {1: 0}, [(0, 1)]
    while heap:
        d, at = heapq.heappop(heap)
        for a, b in EDGES:
            if a == at and d + weigh(a, b) < best.get(b, 1e9):
                best[b] = d + weigh(a, b)
                heapq.heappush(heap, (best[b], b))
    return {n: best.get(n) for n in range(NODES)}


def test_paths_and_components_of_all_rows(spark, folder):
    assert found(spark, folder, "graph_all_bfs") == shortest(lambda a, b: 1)
    assert found(spark, folder, "graph_all_dijkstra") == shortest(lambda a, b: 1 + (a * 31 + b * 17) % 7)
    label = list(range(NODES))
    for _ in range(len(EDGES)):
        for a, b in EDGES:
            label[a] = label[b] = min(label[a], label[b])
    assert found(spark, folder, "graph_all_components") == dict(enumerate(label))


def test_pagerank_of_all_rows(spark, folder):
    out = {n: [b for a, b in EDGES if a == n] for n in range(NODES)}
    rank = [1 / NODES] * NODES
    for _ in range(5):
        spare = sum(rank[n] for n in range(NODES) if not out[n])
        new = [0.15 / NODES + 0.85 * spare / NODES] * NODES
        for n, ends in out.items():
            for b in ends:
                new[b] += 0.85 * rank[n] / len(ends)
        rank = new
    assert found(spark, folder, "graph_all_pagerank") == pytest.approx(dict(enumerate(rank)), abs=2e-9)


def test_depth_first_over_all_orders(spark):
    at = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{at}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    n = max(c for c, _ in orders) + 1
    onward = {}
    for a, b in sorted({(c, o * 7919 % n) for c, o in orders}):
        onward.setdefault(a, []).append(b)
    order, stack = {}, [min(c for c, _ in orders)]
    while stack:
        node = stack.pop()
        if node not in order:
            order[node] = len(order)
            stack += reversed(onward.get(node, []))
    got = {r[0]: r[1] for r in QUERIES["graph_dfs"](spark, at).collect()}
    assert got == {v: order.get(v) for v in range(n)} and len(order) > 20


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n.startswith("graph_all_")])
def test_sql_agrees_on_all_rows(spark, folder, name):
    for at in (folder, "/root/testdata/sf0.001"):
        con = duckdb.connect()
        for table in ("orders", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet{'/*.parquet' if at == folder else ''}'")
        want = con.execute(ORACLE_SQL[name]).fetchall()
        got = QUERIES[name](spark, at).collect()
        assert sorted((k, None if v is None else round(v, 8)) for k, v in got) == sorted((k, None if v is None else round(v, 8)) for k, v in want)
