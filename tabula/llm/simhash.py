"""SimHash near-duplicates: fingerprints, links at a few differing bits, and groups of linked documents.

Fingerprints are embedded as the bit counts of their 32 two-bit segments. Counts 0, 1, 2 are held in unary (00, 01,
11), so the Manhattan distance of two embeddings is one popcount of an exclusive or; it never exceeds the Hamming
distance. Two embeddings within distance 2 differ in at most two of five bands of segments, so they share the grid cell
of at least one of the ten triples of bands: an equi-join on cells finds every candidate, the Manhattan bound prunes
them, and the Hamming distance decides. Cells of more than CROWD fingerprints are not joined pairwise: their
fingerprints meet at the points that differ from them by at most one bit, of which two fingerprints share one exactly
if they differ by two bits or fewer. No point has more than 65 fingerprints, so crowded cells stay linear and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.llm.shared import join_small, kept, small_batches
from tabula.operators.components import linked_components

#: Largest number of differing bits that links; the bands below are made for it.
LINK_BITS = 2
#: First bit and width of the bands: whole two-bit segments.
BANDS = ((0, 14), (14, 14), (28, 12), (40, 12), (52, 12))
CROWD = 48
EVEN_BITS = 0x5555555555555555
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Shingles hashed at once.
_CHUNK = 1 << 16


def text_fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of UTF-8 `text`; A-Z are lower-cased; no word: 0."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    set_bits = np.zeros(64, dtype=np.int64)
    digest, base = xxhash.xxh64_intdigest, 256 * np.arange(8)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        by_value = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + base).ravel(), minlength=2048).reshape(8, 256)
        set_bits += (by_value @ _BYTE_BITS).ravel()
    value = int(_POWERS[2 * set_bits > len(starts)].sum(dtype=np.uint64))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of `docs`; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [text_fingerprint(x, words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit count of each two-bit segment, in unary."""
    low = fp.bitwiseAND(F.lit(EVEN_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low).bitwiseOR(high)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cells(counts: Column) -> Column:
    """The grid cells of all triples of bands."""
    cells = []
    for n, triple in enumerate(combinations(BANDS, 3)):
        mask = sum(((1 << width) - 1) << at for at, width in triple)
        cells.append(F.struct(F.lit(n).alias("grid"), counts.bitwiseAND(F.lit(_signed(mask))).alias("cell")))
    return F.array(*cells)


def fingerprint_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) pairs of fingerprints, of the column `fp`, whose Hamming distance is at most LINK_BITS.

    All such pairs from cells of up to `crowd` fingerprints; from larger cells enough of them to connect whatever any
    of them connects.
    """
    placed = distinct.select("fp", segment_counts(F.col("fp")).alias("counts"))
    celled = placed.select("fp", "counts", F.explode(_cells(F.col("counts"))).alias("at")).select("fp", "counts", "at.*")
    shared = celled.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = kept(celled.join(shared, ["grid", "cell"]), "simhash-cells")
    left = members.filter(F.col("n") <= crowd).select("grid", "cell", F.col("fp").alias("a"), F.col("counts").alias("ca"))
    right = members.filter(F.col("n") <= crowd).select("grid", "cell", F.col("fp").alias("b"), F.col("counts").alias("cb"))
    near = (
        left.join(right, ["grid", "cell"])
        .filter(F.col("a") < F.col("b"))
        .filter(F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= LINK_BITS)
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << n)) for n in range(64)])
    met = (
        members.filter(F.col("n") > crowd).select("fp").distinct()
        .select("fp", F.explode(F.transform(flips, lambda flip: F.col("fp").bitwiseXOR(flip))).alias("point"))
        .groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("around"))
        .filter(F.size("around") > 1)
        .select("a", F.explode("around").alias("b"))
        .filter("a <> b")
    )
    return near.unionByName(met).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    fingerprint is 16 hex digits; component_id is the smallest doc_id reachable over links, the document's own
    included. Null and blank texts have fingerprint zero and are linked like any other. Rows with a null doc_id take
    part and get the smallest id of their group, null if the group has none. Repeated rows are returned as often as
    they occur. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    marked = kept(fingerprints(docs, doc_id, text, words), "simhash-fingerprints")
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    groups = linked_components(fingerprint_links(distinct, crowd), "a", "b")
    linked = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def firsts(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group in `found` (doc_id, component_id), one row for each id.

    Rows with equal ids count as one document, which goes if any of its rows is a copy of a document with a smaller
    id; of those of one that stays, the row of the smallest hash of its values is left. Rows without an id stay. The ids that go are broadcast where they were counted to be few; else texts are
    shuffled by id.
    """
    groups = kept(found, "simhash-groups").filter(F.col("doc_id").isNotNull())
    going = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    staying = join_small(docs, going, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti", going.count())
    repeated = not groups.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not repeated:
        return staying
    plain = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.dataType.typeName() != "variant"]
    packed = staying.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(*plain).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    )
    single = packed.groupBy("_id").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    return single.unionByName(staying.filter(F.col(doc_id).isNull()))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of `docs` that `firsts` leaves of the groups at a few differing bits."""
    return firsts(docs, near_duplicates(docs, doc_id, text, words), doc_id)
