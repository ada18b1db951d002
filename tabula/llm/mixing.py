"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed place between 0 and 1 from a hash of its id. A source that needs a part of its words takes
the documents whose place lies below a threshold, so a larger budget always takes a superset. Thresholds come from
histograms: words are summed by source and hash bucket, running sums find the bucket in which the budget runs out, and
only that bucket is refined, 1,024 times finer in each round, until it holds one document. Nothing is sorted and no
source is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.llm.shared import join_small, kept, word_count
from tabula.operators.ordering import number_rows

#: Bits of a document's place, and those that each round of refinement resolves.
PLACE_BITS, ROUND_BITS = 60, 10


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id as text; documents without an id use their text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`sizes` (source, source_size) with each source's target.

    Sources, by code point and null last, weigh `weights` in turn, repeated. They share `share` of all words; a target
    stops at `most` times its source, and what is over is shared anew by weight until none is above. Only sums reach
    the driver.
    """
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "place")
    turn = F.col("place") % len(weights)
    weight = F.lit(float(weights[0]))
    for n, w in enumerate(weights):
        weight = F.when(turn == n, F.lit(float(w))).otherwise(weight)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level, full = 0.0, -1
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == full or row["open"] == 0:
            break
        full, level = row["n"], (share * total - row["used"]) / row["open"]
    if row["open"] == 0:
        return ranked.withColumn("target", F.col("most")).drop("place", "weight", "most")
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target).drop("place", "weight", "most")


def thresholds(sized: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """`targets` with `times`, how often every document of the source is taken, and the threshold (`edge`, `edge_in`,
    `resolved` bits) below which documents are taken once more."""
    spare = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.withColumn("times", spare.cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    state = kept(
        state.withColumns({"edge": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "edge_size": F.lit(0).cast("long")}),
        "mix-targets",
    )
    resolved = 0
    while resolved < PLACE_BITS:
        edge = state.select(F.col("source").alias("s"), F.col("edge").alias("old"), F.col("below").alias("base"), "rest")
        here = join_small(sized, edge, F.col("source").eqNullSafe(F.col("s")), "inner", n_sources)
        if resolved:
            here = here.filter(F.shiftright("place", PLACE_BITS - resolved) == F.col("old"))
        resolved += ROUND_BITS
        bucket = F.shiftright("place", PLACE_BITS - resolved)
        histogram = here.groupBy("source", "base", "rest", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        upto = histogram.withColumn("upto", F.col("base") + F.sum("words").over(running))
        first = (
            upto.filter(F.col("upto") > F.col("rest"))
            .groupBy(F.col("source").alias("s"))
            .agg(F.min_by(F.struct("bucket", "words", "upto", "docs"), "bucket").alias("b"))
        )
        state = kept(
            state.join(first, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "times", "rest",
                F.coalesce("b.bucket", F.shiftleft("edge", ROUND_BITS)).alias("edge"),
                F.coalesce(F.col("b.upto") - F.col("b.words"), F.col("below")).alias("below"),
                F.coalesce("b.words", "edge_size").alias("edge_size"),
                F.coalesce("b.docs", F.lit(0)).alias("docs"),
            ),
            "mix-state",
        )
        if (state.agg(F.max("docs").alias("d")).first()["d"] or 0) <= 1:
            break
    nearer = F.col("rest") - F.col("below") > F.col("below") + F.col("edge_size") - F.col("rest")
    return state.withColumn("edge_in", nearer & (F.col("rest") > 0)).withColumn("resolved", F.lit(resolved))


def _bounds(docs: DataFrame, doc_id: str, source: str, text: str, weights, share: float, most: float) -> tuple[DataFrame, DataFrame, int]:
    """Every row's doc_id, source, size and place, from a table in which words are counted once; the sources' bounds;
    and the number of sources."""
    sized = kept(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        place(F.col(doc_id), F.col(text)).alias("place"),
    ), "mix-sizes")
    sizes = kept(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n_sources = sizes.count()
    bounds = thresholds(sized.select("source", "size", "place"), source_targets(sizes, weights, share, most), n_sources)
    return sized, bounds.withColumnRenamed("source", "s"), n_sources


def _times(rows: DataFrame, bounds: DataFrame, n_sources: int) -> DataFrame:
    """`rows` (source, place, and more) with `times`, how often the mix takes each: the few bounds of its source join
    every row where it is."""
    joined = join_small(rows, bounds, F.col("source").eqNullSafe(F.col("s")), "inner", n_sources)
    prefix = F.expr(f"shiftright(place, {PLACE_BITS} - resolved)")
    once_more = (F.col("rest") > 0) & ((prefix < F.col("edge")) | ((prefix == F.col("edge")) & F.col("edge_in")))
    return joined.withColumn("times", F.col("times") + F.when(once_more, 1).otherwise(0))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`.

    size counts the words of the text (null: 0); taken is how many words of the document the mix takes, repeats
    counted. A null source is a source of its own. Rows with equal ids share a place and are taken together, rows
    without an id by their text; documents without words are taken with zero words. The last document of a source is
    taken where that brings the source nearer to its target. An empty table gives an empty result. Other columns,
    whatever their names, are not read.
    """
    decided = _times(*_bounds(docs, doc_id, source, text, weights, share, most))
    taken = (F.col("size") * F.col("times")).alias("taken")
    return decided.select("doc_id", "source", "size", "source_size", "target", taken)


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken. No text moves between tasks."""
    _, bounds, n_sources = _bounds(docs, doc_id, source, text, weights, share, most)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
        place(F.col(doc_id), F.col(text)).alias("place"),
    )
    decided = _times(rows, bounds, n_sources).filter("times > 0")
    return decided.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
