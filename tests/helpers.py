"""Comparing small frames with literal rows."""

from tabula.frame import columns, table
from tabula.operators.ordering import ROW


def rows(df, *names):
    """Rows as tuples, in row order where there is one."""
    names = names or columns(df)
    df = df.orderBy(ROW) if ROW in df.columns else df
    return [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]


def unordered(df, *names):
    return sorted(rows(df, *names), key=repr)


def make(spark, **columns_):
    """A frame from name=(kind, values)."""
    return table(spark, [(n.replace("__", "-"), kind, values) for n, (kind, values) in columns_.items()])
