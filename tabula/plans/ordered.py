"""Sorts and windows that can be inspected before they run, beside `tabula.plans.query.Query`."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.frame import columns
from tabula.operators import ordering, windows
from tabula.operators.ordering import ROW

WINDOWS = {
    "row_number": windows.row_number, "rank": windows.rank, "dense_rank": windows.dense_rank, "lag": windows.lag, "lead": windows.lead,
}


class _Plan:
    """What a plan reads is a narrowed table; the row order, where there is one, always goes along."""

    df: DataFrame

    def referenced_columns(self) -> list[str]:
        raise NotImplementedError

    def project(self) -> DataFrame:
        order = [ROW] if ROW in self.df.columns else []
        return self.df.select(*[F.col(f"`{c}`") for c in [*self.referenced_columns(), *order]])

    def analyze(self) -> dict[str, Any]:
        return {
            "type": self.kind, "n-rows": self.df.count(), "n-cols-referenced": len(self.referenced_columns()),
            "n-cols-total": len(columns(self.df)),
        }


@dataclass(frozen=True)
class SortPlan(_Plan):
    """A stable sort by [(column, "asc" or "desc"), ...]."""

    df: DataFrame
    keys: tuple[tuple[str, str], ...]
    kind = "sort"

    def referenced_columns(self) -> list[str]:
        used = {name for name, _ in self.keys}
        return [c for c in columns(self.df) if c in used]

    def run(self) -> DataFrame:
        return ordering.sort_table(self.df, self.keys)


@dataclass(frozen=True)
class WindowPlan(_Plan):
    """One of WINDOWS with its arguments; `name` is the column it looks at, none for row numbers."""

    df: DataFrame
    function: str
    name: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    kind = "window"

    def __post_init__(self) -> None:
        if self.function not in WINDOWS:
            raise ValueError(f"unknown window {self.function!r}")

    def referenced_columns(self) -> list[str]:
        used = {self.name, *self.options.get("partition_by", ())}
        return [c for c in columns(self.df) if c in used]

    def run(self) -> DataFrame:
        return WINDOWS[self.function](self.df, *([] if self.name is None else [self.name]), **self.options)


def sort_plan(df: DataFrame, keys: list[tuple[str, str]]) -> SortPlan:
    return SortPlan(df, tuple(keys))


def window_plan(df: DataFrame, function: str, name: str | None = None, **options: Any) -> WindowPlan:
    return WindowPlan(df, function, name, options)
