"""Exact top-k inner products by pivot-table elimination.

Distances to many pivots, the pivot table, bound distances between vectors: by the triangle inequality the largest
difference of two vectors' pivot distances is a lower bound of their distance, and with their norms gives an upper bound
of their inner product. Vectors are dealt into blocks by their nearest pivot. A query first meets the block that it lies
in, which gives it a k-th best score to begin with, and then all other blocks. In a block candidates of one nearest pivot
and of like distance to it form groups, which the pivot table bounds by their least and greatest distances to the pivots.
A query evaluates the group of the best bound first and then those whose bounds reach its k-th best score; the queries
that reach a group do so in one matrix product. The block results of a query are ranked together at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.llm.shared import kept

#: Pivots: PIVOT_GROWTH times the root of the rows, within bounds. They are picked among so many times as many vectors,
#: those of the smallest hashes, of SAMPLE_BYTES at most.
PIVOT_GROWTH, FEWEST_PIVOTS, MOST_PIVOTS, PIVOT_SAMPLE, SAMPLE_BYTES = 2, 16, 256, 4, 64 << 20
#: Bounds are taken with so many of the pivots, those that lie nearest to the query: they bound best.
NEAREST = 16
#: Bytes of the queries and of the candidates of a block; candidates that are worth a task; candidates of a group; scores
#: held at once.
QUERY_BYTES, CANDIDATE_BYTES, WORTHWHILE, GROUP, SCORES = 16 << 20, 16 << 20, 4096, 64, 1 << 21
SCALE = 64


def quantised(column: pa.Array) -> np.ndarray:
    """floor(64 x) of lists of equal length, as a matrix of doubles; what leaves the range of doubles is clipped."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * flat)).reshape(len(column), -1)


def farthest_first(vectors: np.ndarray, count: int) -> np.ndarray:
    """Pivots that lie far from one another, beginning with the first vector."""
    picked, reach = [], np.full(len(vectors), np.inf)
    at = 0
    for _ in range(min(count, len(vectors))):
        picked.append(at)
        reach = np.minimum(reach, np.sqrt(((vectors - vectors[at]) ** 2).sum(1)))
        at = int(reach.argmax())
        if reach[at] == 0:
            break
    return vectors[picked]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def _saturated(value: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, value))


def candidate_groups(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the candidates and where its groups begin; `table` has a row of distances for each pivot."""
    count = table.shape[1]
    if not len(table):
        return np.arange(count), np.arange(0, count, GROUP)
    home = table.argmin(0)
    order = np.lexsort((table[home, np.arange(count)], home))
    edges = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0, True])
    return order, np.concatenate([np.arange(at, to, GROUP) for at, to in zip(edges, edges[1:])])


def group_bounds(
    low: np.ndarray, high: np.ndarray, most: np.ndarray, query_norms: np.ndarray, far: np.ndarray, slack: float
) -> np.ndarray:
    """Upper bounds of the inner products of queries with the vectors of groups.

    `low` and `high` have a row for each pivot, the range of the groups' distances to it; `most` is the greatest squared
    norm of a group, `far` the queries' distances to the pivots. The greatest gap between a query's distance and a range,
    of the NEAREST pivots to the query, is the least distance.
    """
    gap = np.zeros((len(far), len(most)))
    count = min(NEAREST, far.shape[1])
    near = np.argpartition(far, count - 1)[:, :count] if count else np.zeros((len(far), 0), dtype=np.int64)
    for p in near.T:
        own = far[np.arange(len(far)), p][:, None]
        np.maximum(gap, np.maximum(low[p] - own, own - high[p]), out=gap)
    squared = query_norms[:, None] + most
    return np.minimum((squared - gap * gap) / 2, np.sqrt(query_norms)[:, None] * np.sqrt(most)) + slack


def grouped_search(
    rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, least: np.ndarray, pivots: np.ndarray,
    k: int, kind: type, slack: float,
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, scores, evaluated) for each query: all candidates among its k best, and maybe others, in no order."""
    table = np.ascontiguousarray(pivot_distances(vectors, pivots).T)
    order, begins = candidate_groups(table)
    ends = np.r_[begins[1:], len(order)]
    table, data, norms = table[:, order], vectors[order].astype(kind), (vectors[order] ** 2).sum(1)
    low, high = np.minimum.reduceat(table, begins, axis=1), np.maximum.reduceat(table, begins, axis=1)
    most, place = np.maximum.reduceat(norms, begins), dict(zip(rows[order].tolist(), range(len(rows))))
    step = max(1, SCORES // len(order))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        asked, kth = part.astype(kind), least[at : at + step].astype(np.float64)
        scores = np.full((len(part), len(order)), -np.inf, dtype=kind)
        own = [(n, place[row]) for n, row in enumerate(query_rows[at : at + step].tolist()) if row in place]
        bound = group_bounds(low, high, most, (part**2).sum(1), pivot_distances(part, pivots), slack)
        best, seen = bound.argmax(1), np.zeros(bound.shape, dtype=bool)
        best[np.isfinite(kth)] = -1
        for first in (True, False):
            reach = best[:, None] == np.arange(len(begins)) if first else ~seen & (bound >= kth[:, None])
            for g in np.flatnonzero(reach.any(0)):
                those = np.flatnonzero(reach[:, g])
                scores[those, begins[g] : ends[g]] = asked[those] @ data[begins[g] : ends[g]].T
            seen |= reach
            for n, position in own:
                scores[n, position] = -np.inf
            if len(order) >= k:
                open_ = np.flatnonzero(reach.any(1) & (first | ~np.isfinite(kth) | (best >= 0)))
                if len(open_):
                    kth[open_] = np.maximum(kth[open_], np.partition(scores[open_], len(order) - k, axis=1)[:, len(order) - k])
        evaluated = seen @ (ends - begins)
        for n, position in own:
            evaluated[n] -= seen[n, np.searchsorted(begins, position, side="right") - 1]
        query, found = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
        cuts = np.searchsorted(query, np.arange(len(part) + 1))
        for n in range(len(part)):
            hits = found[cuts[n] : cuts[n + 1]]
            yield order[hits], scores[n, hits], int(evaluated[n])


def block_search(
    rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, least: np.ndarray,
    pivots: np.ndarray, k: int,
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, scores, evaluated) of the k best candidates of a block for each query, ties to smaller ids.

    `rows` tells candidates apart, `ids` breaks ties, and `least` is a k-th best score that is known of each query.
    """
    norms, query_norms = (vectors**2).sum(1), (queries**2).sum(1)
    largest = float(np.sqrt(norms.max(initial=0)) * np.sqrt(query_norms.max(initial=0)))
    if largest < 2**52:
        kind = np.float32 if largest < 2**23 else np.float64
        slack = 1e-9 * (norms.max(initial=0) + query_norms.max(initial=0)) + 1e-6
        for at, scores, evaluated in grouped_search(rows, vectors, query_rows, queries, least, pivots, k, kind, slack):
            top = np.lexsort((ids[at], -scores.astype(np.float64)))[:k]
            yield at[top], scores[top].astype(np.int64), evaluated
        return
    data, asked = (np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object) for m in (vectors, queries))
    for n, own in enumerate(query_rows):
        at = np.flatnonzero(rows != own)
        scores = [_saturated(int(x)) for x in data[at] @ asked[n]]
        top = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
        yield at[top], np.array([scores[i] for i in top], dtype=np.int64), len(at)


def dealt_blocks(counts: dict[tuple[int, int], int], blocks: int) -> list[tuple[int, int, int, int, int, int]]:
    """(dim, home, base, pieces, low, high): the blocks `base` to `base + pieces - 1` of the vectors that are nearest to
    a pivot, and the range of blocks of their length. Small neighbours share a block; a pivot with more vectors than a
    block should have, such as one of many equal vectors, has several."""
    target, out, at = max(1, -(-sum(counts.values()) // blocks)), [], 0
    for dim in sorted({d for d, _ in counts}):
        low, filled, own = at, 0, []
        for home in sorted(h for d, h in counts if d == dim):
            n = counts[(dim, home)]
            if filled and filled + n > target:
                at, filled = at + 1, 0
            pieces = max(1, -(-n // target))
            own.append((dim, home, at, pieces))
            at, filled = (at, filled + n) if pieces == 1 else (at + pieces, 0)
        at += filled > 0
        out += [(*o, low, at) for o in own]
    return out


def block_results(
    vectors: DataFrame, k: int, every: int, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None
) -> DataFrame:
    """(query_row, query_id, vec_id, score, evaluated): the best of every block that a query met."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = (
        vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
        .filter(F.col("embedding").isNotNull() & finite).withColumn("dim", F.size("embedding"))
    )
    valid = kept(valid, "topk-vectors")
    facts = valid.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    n, widest = facts["n"], max(1, facts["dim"] or 1)
    pivots = pivots or min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(PIVOT_GROWTH * math.sqrt(n))))
    wanted = max(1, min(PIVOT_SAMPLE * pivots, SAMPLE_BYTES // (8 * widest)))
    sample = valid.orderBy(F.xxhash64("row"), "row").limit(wanted).collect()
    chosen: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in sample}):
        own = [r["embedding"] for r in sample if r["dim"] == dim]
        far = farthest_first(quantised(pa.array(own, pa.list_(pa.float64()))), pivots)
        chosen[dim] = far[np.argsort(pivot_distances(far, far[:1])[:, 0], kind="stable")]  # neighbours by number
    of_dim = lambda dim, width: chosen.get(int(dim), np.zeros((0, width)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                whole = quantised(part.column("embedding"))
                far = pivot_distances(whole, of_dim(dim, whole.shape[1]))
                home = far.argmin(1) if far.shape[1] else np.zeros(len(part), dtype=np.int64)
                offsets = np.arange(len(part) + 1, dtype=np.int32)
                vector = pa.ListArray.from_arrays(offsets * whole.shape[1], whole.ravel())
                names = ["row", "vec_id", "dim", "home", "vector"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("vec_id"), part.column("dim"), pa.array(home.astype(np.int32)), vector], names
                )

    homed = kept(valid.mapInArrow(place, "row long, vec_id long, dim int, home int, vector array<double>"), "topk-homes")
    counts = {(r["dim"], r["home"]): r["count"] for r in homed.groupBy("dim", "home").count().collect()}
    spread = min(2 * spark.sparkContext.defaultParallelism, -(-n // WORTHWHILE))
    blocks = dealt_blocks(counts, max(1, -(-8 * n * widest // CANDIDATE_BYTES), spread))
    of_home = spark.createDataFrame(blocks, "dim int, home int, base int, pieces int, low int, high int")
    block = (F.col("base") + F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int")
    placed = homed.join(F.broadcast(of_home), ["dim", "home"]).select("row", "vec_id", "dim", "vector", block.alias("block"), "low", "high")
    placed = kept(placed, "topk-blocks")
    queries = placed.toDF(*placed.columns).filter(F.col("vec_id") % every == 0)  # columns apart from those of the candidates
    query_blocks = max(1, -(-8 * queries.count() * widest // QUERY_BYTES))

    def meet(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        asked, candidates = asked.combine_chunks(), candidates.combine_chunks()
        schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("evaluated", pa.int64())])
        if not len(asked) or not len(candidates):
            return schema.empty_table()
        width = asked.column("dim")[0].as_py()
        matrix = lambda side: side.column("vector").combine_chunks().flatten().to_numpy().reshape(len(side), width)
        ids = candidates.column("vec_id")
        rows, query_ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        found = list(block_search(
            candidates.column("row").to_numpy(), ids.fill_null((1 << 63) - 1).to_numpy(), matrix(candidates), rows, matrix(asked),
            asked.column("least").fill_null(-np.inf).to_numpy(), of_dim(width, width), k,
        ))
        many = [len(at) for at, _, _ in found]
        at, scores = (np.concatenate([f[n] for f in found]) for n in (0, 1))
        own = [np.repeat(x, many) for x in (rows, query_ids)]
        return pa.table([*own, ids.take(pa.array(at)), pa.array(scores), np.repeat([f[2] for f in found], many)], schema=schema)

    names = "query_row long, query_id long, vec_id long, score long, evaluated long"
    here = queries.select("dim", "block", "row", "vec_id", "vector", F.lit(None).cast("double").alias("least"))
    keys = ["dim", "block"]
    first = kept(
        here.groupBy(*keys).cogroup(placed.select(*keys, "row", "vec_id", "vector").groupBy(*keys)).applyInArrow(meet, names), "topk-own-blocks"
    )
    known = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
    keys = ["dim", "query_block", "block"]
    elsewhere = F.filter(F.sequence(F.col("low"), F.col("high") - 1), lambda b: b != F.col("block"))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")).join(known, "row", "left").select(
        "dim", "query_block", F.explode(elsewhere).alias("block"), "row", "vec_id", "vector", "least"
    )
    every_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block")
    searched = placed.select("dim", every_block, "block", "row", "vec_id", "vector")
    return first.unionByName(asked.groupBy(*keys).cogroup(searched.groupBy(*keys)).applyInArrow(meet, names))


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores for every row whose id is divisible by `every`.

    Components x become floor(64 x) in doubles; the score is the integer inner product with every other row, ranks
    start at 1 and ties go to the smaller id, null ids last. Vectors that are null or hold null or non-finite components
    take no part. Rows with equal ids are rows of their own, as queries and as candidates; a row without an id is a
    candidate. Only vectors of equal length are compared; empty ones score 0. Scores beyond 64 bits are the nearest
    64-bit value, also for the ranks. A query without other vectors has no rows. Other columns are not read.
    """
    best = block_results(vectors, k, every, vec_id, embedding, pivots)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
