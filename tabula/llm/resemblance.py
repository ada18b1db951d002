"""Near copies by the Jaccard coefficient of word shingles: MinHash bands find candidates, whole sets confirm them.

A text is the set of its shingles of five words; equal sets are one node from the start. Sets that agree in the four
minima of any of 24 bands share a cell; two sets of coefficient 0.8 share none with probability (1 - 0.8^4)^24, about
three in a million, and less above. Pairs of a cell are drawn only where six bits of each of the 96 minima agree in
at least the coefficient less FAINT of all places; a pair of exactly 0.8 falls below with probability of about one in
20,000. Each pair that is left is decided by its exact coefficient.

The links of operator 10, SimHash fingerprints within two bits, are taken first, whatever their coefficient; the
coefficient adds what two bits miss.

Groups of copies are linked step by step, so that pairs stay far below all pairs of a group: in STARS rounds every set
meets the most similar of the centres of its cells that aren't of its component yet; then, in cells that still hold
several components, the sets outside the largest of them meet all others, likely pairs before unlikely ones. Cells of
more than CROWD sets are not joined: their sets meet in tasks, block by block, by sketches of FINE minima. A first pass
returns of each pair of blocks only a forest of likely links, the second one every pair of sets that still are of
different components and whose sketches agree in at least the coefficient less FINE_FAINT of all places, each pair from
the first cell that it shares; a pair of exactly 0.8 falls below with probability of about one in 20,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import kept, small_batches
from tabula.llm.simhash import fingerprint_links, firsts, text_fingerprint
from tabula.operators.components import linked_components
from tabula.session import release, scratch, scratch_mark

#: Words of a shingle and the least coefficient of a link.
WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Rounds in which every set meets one other.
STARS = 2
#: Sets of a cell from which on they meet in tasks. Such a cell has BLOCKS blocks, but of LEAST_BLOCK to MOST_BLOCK sets.
CROWD, BLOCKS, LEAST_BLOCK, MOST_BLOCK = 64, 8, 384, 4096
#: Minima of a sketch there, one byte each; below the coefficient by more than FINE_FAINT a pair is dropped; shares of
#: equal minima from which on pairs make up the forest, safer ones first.
FINE, FINE_FAINT, FOREST = 512, 0.072, (0.04, 0.0)
#: A pair of fewer equal minima than the coefficient less FAINT is dropped; one of more than it less LIKELY is decided first.
FAINT, LIKELY = 0.16, 0.03
#: Bits of a minimum in a sketch, and of eight of them in one long: no bit moves on to the next when it is added to.
_SIX, _FULL, _SEVENTH = np.uint64(0x3F), 0x3F3F3F3F3F3F3F3F, 0x4040404040404040
LONGS = BANDS * ROWS // 8
#: Pairs of one set that meet its shingles in one task.
SHARE = 256
#: Shingles hashed at once.
_CHUNK = 1 << 13
_FACTORS, _FINE_FACTORS = (
    np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for seed, count in ((42, BANDS * ROWS), (43, FINE))
)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of UTF-8 `text`, A-Z in lower case; a shorter text is one shingle."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    count, digest = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(parts[i : i + words]), 42) for i in range(count)), np.uint64, count))


def minima(hashes: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """The least value of each of the hash functions over a set's shingles."""
    low, chunk = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), _CHUNK * len(_FACTORS) // len(factors)
    for at in range(0, len(hashes), chunk):
        low = np.minimum(low, (hashes[at : at + chunk, None] * factors).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> list[int]:
    """One key for each band: a hash of its minima."""
    return [xxhash.xxh64_intdigest(low[n * ROWS : (n + 1) * ROWS].tobytes(), n) - (1 << 63) for n in range(BANDS)]


def sketch(low: np.ndarray) -> list[int]:
    """Six bits of each minimum, eight to a long."""
    return ((low >> np.uint64(24)) & _SIX).astype(np.uint8).view("<i8").tolist()


def fine_sketch(hashes: np.ndarray) -> bytes:
    """A byte of each of FINE minima."""
    return (minima(hashes, _FINE_FACTORS) >> np.uint64(24)).astype(np.uint8).tobytes()


def equal_minima(one: str, other: str) -> Column:
    """In how many places two sketches agree."""
    differing = [F.bit_count((F.col(one)[n].bitwiseXOR(F.col(other)[n]) + F.lit(_FULL)).bitwiseAND(F.lit(_SEVENTH))) for n in range(LONGS)]
    return F.lit(BANDS * ROWS) - sum(differing[1:], differing[0])


def _set_id(held: bytes) -> int:
    return xxhash.xxh64_intdigest(held, 7) - (1 << 63)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _fit(one: str, other: str, least: float) -> Column:
    """Whether sets of these sizes can have the coefficient."""
    return F.least(one, other) >= least * F.greatest(one, other) - 1e-9


def cells(sets: DataFrame) -> DataFrame:
    """(band, cell, set, size, sketch) of the cells that several of `sets` share."""
    celled = sets.select("set", "size", F.posexplode("keys").alias("band", "cell"))
    shared = celled.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return celled.join(shared, ["band", "cell"]).join(sets.select("set", "sketch"), "set")


def _least_equal(least: float, below: float) -> int:
    return int(np.ceil((least - below) * BANDS * ROWS))


def star_pairs(members: DataFrame, star: int, least: float) -> DataFrame:
    """(a, b): every set of `members` beside the most similar of the centres of its cells that are of other components."""
    place = F.struct(F.xxhash64("set", F.lit(star)).alias("place"), "set", "size", "comp", "sketch")
    first = members.groupBy("band", "cell").agg(F.min(place).alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = members.join(first.filter("low <> high").drop("low", "high"), ["band", "cell"]).filter("first.comp <> comp")
    met = other.filter(_fit("first.size", "size", least)).withColumn("equal", equal_minima("first.sketch", "sketch"))
    met = met.filter(F.col("equal") >= _least_equal(least, FAINT))
    best = met.groupBy(F.col("set").alias("b")).agg(F.max(F.struct("equal", F.col("first.set").alias("a"))).alias("best"))
    return best.select("best.a", "b")


def _open(members: DataFrame, on: list[str]) -> DataFrame:
    """The members of cells with several components, with the component of most and the cell's size."""
    parts = members.groupBy(*on, "comp").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy(*on).agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max_by("comp", "n").alias("main"))
    return members.join(several.filter("comps > 1").drop("comps"), on)


def _across(members: DataFrame, on: list[str], least: float) -> DataFrame:
    """Pairs of different components in one cell: the sets outside the largest one beside all others."""
    named = {"set": "a", "size": "na", "comp": "ca", "sketch": "sa"}
    left = members.select(*on, *[F.col(k).alias(v) for k, v in named.items()])
    right = members.filter("comp <> main").select(*on, *[F.col(k).alias(v.replace("a", "b")) for k, v in named.items()])
    pairs = left.join(right, on).filter("ca <> cb").filter(_fit("na", "nb", least)).withColumn("equal", equal_minima("sa", "sb"))
    return pairs.filter(F.col("equal") >= _least_equal(least, FAINT)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "equal")


def met_pairs(
    part: np.ndarray, comp: np.ndarray, size: np.ndarray, fine: np.ndarray, keys: np.ndarray | None, band: int, least: float
) -> tuple[list[int], list[int]]:
    """Positions of the pairs of two blocks of a cell, or of one, that may reach `least` and are of different components.

    Without `keys`: likely pairs only, of which each joins what those before it have left apart. With the sets' keys: all
    pairs but those that share a cell of a band before `band`.
    """
    root, (low, high) = np.unique(comp, return_inverse=True)[1], (part.min(), part.max())
    left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
    ones: list[int] = []
    others: list[int] = []
    for above in FOREST if keys is None else (-FINE_FAINT,):
        for n, a in enumerate(left):
            b = right[n + 1 :] if low == high else right
            fit = np.minimum(size[b], size[a]) >= least * np.maximum(size[b], size[a]) - 1e-9
            b = b[(root[b] != root[a]) & fit]
            if not len(b):
                continue
            equal = np.bitwise_count((fine[b] == fine[a]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = equal >= (least + above) * FINE
            if keys is None:
                for x in b[near][np.argsort(-equal[near], kind="stable")]:
                    if root[x] != root[a]:
                        ones.append(int(a))
                        others.append(int(x))
                        root[root == root[x]] = root[a]
            else:
                new = b[near][~(keys[b[near], :band] == keys[a, :band]).any(axis=1)]
                ones += [int(a)] * len(new)
                others += new.tolist()
    return ones, others


def crowded_pairs(crowded: DataFrame, fines: DataFrame, least: float, forest: bool) -> DataFrame:
    """(a, b) of `crowded` (band, cell, set, size, comp, n) by `met_pairs`, with `fines` (set, fine, keys); every two
    blocks of a cell meet in one group of their own, so no group is larger than two blocks."""

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).to_numpy()
        fine = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint8).reshape(len(rows), FINE)
        keys = None if forest else rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), BANDS)
        one, other = met_pairs(column("part"), column("comp"), column("size"), fine, keys, rows.column("band")[0].as_py(), least)
        a, b = column("set")[one], column("set")[other]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("n") / BLOCKS)))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = crowded.join(fines, "set").withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("set", F.lit("block")), "blocks").cast("int"))
    beside = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    beside = beside.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")})
    columns = ["band", "cell", "one", "two", "part", "set", "size", "comp", "fine", *([] if forest else ["keys"])]
    pairs = beside.select(*columns).groupBy("band", "cell", "one", "two").applyInArrow(meet, "a long, b long")
    return kept(pairs.distinct(), "resemblance-met")


def fine_sketches(sets: DataFrame, bodies: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set, fine, keys) of the sets that `chosen` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [fine_sketch(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], ["set", "fine"])

    wanted = chosen.select("set").distinct()
    made = bodies.join(wanted, "set", "left_semi").select("set", "hashes").mapInArrow(run, "set long, fine binary")
    return kept(made.join(sets.select("set", "keys"), "set"), "resemblance-fine")


def attached(pairs: DataFrame, side: str, values: DataFrame, value: str) -> DataFrame:
    """`pairs` with `value` of the set in column `side`; a set of many pairs is spread over several parts."""
    heads = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts"))
    spread = pairs.join(heads, side).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int")).drop("parts")
    copies = values.select(F.col("set").alias(side), F.col(value).alias(f"{value}_{side}")).join(heads, side)
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return spread.join(copies, [side, "part"]).drop("part")


def confirmed(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose exact coefficient is at least `least`."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [jaccard(x.as_py(), y.as_py()) >= least - 1e-12 for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    pairs = kept(pairs.select("a", "b"), "resemblance-pairs")
    both = attached(attached(pairs, "b", bodies, "hashes"), "a", bodies, "hashes")
    return kept(both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(same, "a long, b long"), "resemblance-links")


def bodies_of(rows: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(set, hashes) of the texts whose hash is in `needed` (key): one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(body, words).tobytes() for body in batch.column(0).cast(pa.binary()).to_pylist()]
            ids = [_set_id(x) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], ["set", "hashes"])

    texts = rows.select("text", F.xxhash64("text").alias("key")).join(needed, "key", "left_semi").select("text")
    return texts.mapInArrow(run, "set long, hashes binary").groupBy("set").agg(F.first("hashes").alias("hashes"))


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that connect what operator 10 links, equal fingerprints and those within its few bits."""
    by_fp = kept(marked.select("fp", "set").distinct(), "resemblance-fingerprints")
    first = kept(by_fp.groupBy("fp").agg(F.min("set").alias("a")), "resemblance-first-sets")
    equal = by_fp.join(first, "fp").filter("a <> set").select("a", F.col("set").alias("b"))
    near = fingerprint_links(first.select("fp")).toDF("x", "y")
    for side, fp in (("a", "x"), ("b", "y")):
        near = near.join(first.select(F.col("fp").alias(fp), F.col("a").alias(side)), fp)
    return kept(equal.unionByName(near.select("a", "b")), "resemblance-fingerprint-pairs")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) for every row of `docs`: the smallest id reachable over pairs of at least `least` and over
    the links of operator 10.

    Texts without words are copies of each other. Rows without an id take part; null where a group has no id.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, sizes, keys, sketches = [], [], [], [], []
            for body in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingle_set(body, words)
                low = minima(found)
                ids.append(_set_id(found.tobytes()))
                fps.append(text_fingerprint(body))
                sizes.append(len(found))
                keys.append(band_keys(low) if len(found) else [])
                sketches.append(sketch(low))
            columns = [pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "key", "set", "fp", "size", "keys", "sketch"])

    path = scratch(spark, "resemblance-groups")
    mark = scratch_mark(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    marked = kept(hashed.mapInArrow(run, "doc_id long, key long, set long, fp long, size int, keys array<long>, sketch array<long>"), "resemblance-sets")
    firsts_of = [F.first(name).alias(name) for name in ("size", "keys", "sketch")]
    sets = kept(marked.groupBy("set").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), *firsts_of), "resemblance-distinct")
    members = kept(cells(sets), "resemblance-cells")
    needed = members.select("set").distinct().join(sets.select("set", "key"), "set").select("key")
    bodies = kept(bodies_of(rows, needed, words), "resemblance-bodies")

    links = [fingerprint_pairs(marked), confirmed(star_pairs(members.withColumn("comp", F.col("set")), 0, least), bodies, least)]

    def linked() -> DataFrame:
        return linked_components(reduce(DataFrame.unionByName, links), "a", "b").withColumnRenamed("node", "set")

    def beside(rows: DataFrame, comps: DataFrame, side: str = "set", name: str = "comp") -> DataFrame:
        of = comps.select(F.col("set").alias(side), F.col("component").alias(name))
        return rows.join(of, side, "left").withColumn(name, F.coalesce(name, side))

    for star in range(1, STARS):
        links.append(confirmed(star_pairs(beside(members, linked()), star, least), bodies, least))
    on = ["band", "cell"]
    opened = kept(_open(beside(members, linked()), on), "resemblance-open")
    few = kept(_across(opened.filter(F.col("n") <= crowd), on, least).distinct(), "resemblance-across")
    crowded = opened.filter(F.col("n") > crowd).select("band", "cell", "set", "size", "comp", "n")
    fines = fine_sketches(sets, bodies, crowded)
    likely = F.col("equal") >= _least_equal(least, LIKELY)
    forest = crowded_pairs(crowded, fines, least, True)
    links.append(confirmed(few.filter(likely).select("a", "b").unionByName(forest).distinct(), bodies, least))
    comps = kept(linked(), "resemblance-comps")
    rest = beside(beside(few.filter(~likely), comps, "a", "ca"), comps, "b", "cb").filter("ca <> cb").select("a", "b")
    still = beside(crowded.drop("comp", "n"), comps)
    apart = crowded_pairs(_open(still, on).drop("main"), fines, least, False)
    links.append(confirmed(rest.unionByName(apart).distinct(), bodies, least))
    placed = sets.select("set", "first_id").join(linked(), "set", "left").withColumn("component", F.coalesce("component", "set"))
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(lowest, "component").select("set", "component_id")
    result = marked.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")
    result.write.parquet(path)
    release(spark, mark)
    return spark.read.schema(result.schema).parquet(path)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group, one row for each id; rows without an id stay."""
    return firsts(docs, groups(docs, doc_id, text, words, least), doc_id)
