"""Row selections: which rows of a table are live, by row number, with counts for blocks of 1,024 rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.operators.ordering import ROW, densely_numbered, running_before
from tabula.plans.expr import Predicate

BLOCK_ROWS = 1024
DEAD, LIVE, MIXED = "dead", "live", "mixed"


@dataclass(frozen=True)
class Selection:
    """Rows 0 to n_rows - 1, all live or all dead but for the `flipped` ones. Changing a row gives a new selection.

    Meant for a few changes by hand; selections that come from data are predicates (`live_by_block`).
    """

    n_rows: int
    live: bool
    flipped: frozenset[int] = frozenset()

    def row_live(self, row: int) -> bool:
        self._check(row)
        return self.live != (row in self.flipped)

    def set_row(self, row: int, live: bool) -> Selection:
        self._check(row)
        changed = self.flipped - {row} if live == self.live else self.flipped | {row}
        return Selection(self.n_rows, self.live, changed)

    def _check(self, row: int) -> None:
        if not 0 <= row < self.n_rows:
            raise IndexError(row)

    def popcount(self) -> int:
        return self.n_rows - len(self.flipped) if self.live else len(self.flipped)

    def block_popcount(self, block: int) -> int:
        rows = max(0, min(self.n_rows - block * BLOCK_ROWS, BLOCK_ROWS))
        changed = sum(1 for r in self.flipped if r // BLOCK_ROWS == block)
        return rows - changed if self.live else changed

    def block_flag(self, block: int) -> str:
        found = self.block_popcount(block)
        rows = max(0, min(self.n_rows - block * BLOCK_ROWS, BLOCK_ROWS))
        return DEAD if found == 0 else LIVE if found == rows else MIXED

    def apply(self, df: DataFrame) -> DataFrame:
        """The live rows of a frame with a row order."""
        if not self.flipped:
            return df if self.live else df.filter(F.lit(False))
        inside = F.col(ROW).isin(sorted(self.flipped))
        return df.filter(~inside if self.live else inside)


def selection_all(n_rows: int) -> Selection:
    return Selection(n_rows, True)


def selection_none(n_rows: int) -> Selection:
    return Selection(n_rows, False)


def live_by_block(df: DataFrame, predicate: Predicate) -> DataFrame:
    """(block, rows, live, flag, before): counts of rows for which the predicate holds, for each block of BLOCK_ROWS
    rows of a frame with a row order, and how many live rows lie before the block.

    Row numbers with gaps are made dense first."""
    block = F.floor(F.col(ROW) / BLOCK_ROWS).cast("long").alias("block")
    counts = densely_numbered(df).groupBy(block).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(predicate.compile(df.schema)).alias("live")
    )
    flag = F.when(F.col("live") == 0, DEAD).when(F.col("live") == F.col("rows"), LIVE).otherwise(MIXED)
    return running_before(counts, [F.col("block")], "live", "before").select("block", "rows", "live", flag.alias("flag"), "before")
