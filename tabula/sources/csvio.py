"""CSV with type inference from a sample of rows, and writing.

Types are inferred from the first rows on the ladder null, bool, i64, f64, str. Blank cells are null in every column.
Values that do not parse as the inferred type are an error. Dates stay strings.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.frame import KINDS, columns
from tabula.operators.ordering import ROW
from tabula.session import kept

SAMPLE_ROWS = 100
#: Spellings of booleans and of floating specials, and the shapes of numbers.
TRUE, FALSE = ("true", "TRUE"), ("false", "FALSE")
NAN = ("NaN", "nan")
PLUS_INF = ("Inf", "inf", "+Inf", "+inf", "Infinity", "+Infinity")
MINUS_INF = ("-Inf", "-inf", "-Infinity")
INTEGER = r"^[+-]?\d+$"
FLOATING = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def cell_kind(text: str | None) -> str:
    """null, bool, i64, f64 or str."""
    if text is None or not text.strip():
        return "null"
    if text in TRUE + FALSE:
        return "bool"
    if re.match(INTEGER, text):
        return "i64"
    if re.match(FLOATING, text) or text in NAN + PLUS_INF + MINUS_INF:
        return "f64"
    return "str"


def promoted(kinds: Iterable[str]) -> str:
    """The kind of a column: nothing but nulls is str, booleans beside numbers are str."""
    found = set(kinds) - {"null"}
    if len(found) == 1:
        return found.pop()
    return "f64" if found == {"i64", "f64"} else "str"


def infer_kinds(rows: Sequence[Sequence[str | None]], width: int) -> list[str]:
    return [promoted(cell_kind(r[n]) if n < len(r) else "null" for r in rows) for n in range(width)]


def _parsed(column: Column, kind: str) -> Column:
    text = F.when(F.trim(F.translate(column, "\t\r\n", "   ")) != "", column)
    if kind == "bool":
        wrong = F.raise_error(F.concat(F.lit("not a boolean: "), text))
        return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).when(text.isNull(), F.lit(None)).otherwise(wrong.cast("boolean"))
    if kind == "i64":
        return text.cast("long")
    if kind == "f64":
        special = F.when(text.isin(*PLUS_INF), F.lit(float("inf"))).when(text.isin(*MINUS_INF), F.lit(float("-inf")))
        return special.when(text.isin(*NAN), F.lit(None)).otherwise(F.when(~text.isin(*PLUS_INF, *MINUS_INF, *NAN), text).cast("double"))
    return text


def _typed(raw: DataFrame, names: Sequence[str], types: Mapping[int, str] | None, sample: int) -> DataFrame:
    if types is not None:
        kinds = [types.get(n, "str") for n in range(len(names))]
    else:
        ordered = raw.orderBy(ROW) if ROW in raw.columns else raw
        kinds = infer_kinds([tuple(r)[: len(names)] for r in ordered.limit(sample).collect()], len(names))
    out = [_parsed(F.col(f"`{old}`"), kind if kind in KINDS else "str").alias(new) for old, new, kind in zip(raw.columns, names, kinds)]
    return raw.select(*out, *([ROW] if ROW in raw.columns else []))


def parse_csv(
    text: str | io.TextIOBase, delimiter: str = ",", quote: str = '"', strict: bool = False, end_of_line: str | None = None
) -> list[list[str]]:
    """The records of CSV text or a reader as lists of strings, nothing inferred; blank lines are left out."""
    body = text if isinstance(text, str) else text.read()
    if end_of_line:
        body = body.replace(end_of_line, "\n")
    found = csv.reader(io.StringIO(body, newline=""), delimiter=delimiter, quotechar=quote, strict=strict, doublequote=True)
    return [r for r in found if r]


def read_csv(
    spark: SparkSession, text: str | io.TextIOBase, header: bool = True, types: Mapping[int, str] | None = None,
    delimiter: str = ",", quote: str = '"', strict: bool = False, sample: int = SAMPLE_ROWS, end_of_line: str | None = None,
) -> DataFrame:
    """A table from CSV text or a reader, with row order. For files and folders see read_csv_files.

    `types` maps column numbers to kinds and replaces inference; columns it does not name are strings. Without a header
    columns are col0, col1 and so on, as many as the longest row has. Short rows are filled with nulls, rows longer than
    the header cut.
    """
    rows = parse_csv(text, delimiter, quote, strict, end_of_line)
    names = (rows[0] if rows else []) if header else [f"col{n}" for n in range(max(map(len, rows), default=0))]
    data = rows[1:] if header else rows
    width = len(names)
    filled = [(*[r[n] if n < len(r) else None for n in range(width)], k) for k, r in enumerate(data)]
    schema = T.StructType([T.StructField(f"c{n}", T.StringType()) for n in range(width)] + [T.StructField(ROW, T.LongType(), False)])
    return _typed(spark.createDataFrame(filled, schema), names, types, sample)


def _longest_row(spark: SparkSession, path: str, delimiter: str, quote: str, line_ends: dict[str, str]) -> int:
    """Fields of the longest line of some files; the lines are counted where they are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = csv.reader(batch.column(0).to_pylist(), delimiter=delimiter, quotechar=quote)
            yield pa.RecordBatch.from_pydict({"n": [max(map(len, lines), default=0)]})

    return spark.read.options(**line_ends).text(path).mapInArrow(count, "n long").agg(F.max("n")).first()[0] or 0


def _numbered(lines: DataFrame) -> DataFrame:
    """`lines` with the row order by (_file, _block, _line). A block is read line by line in one task, so that its lines
    are consecutive already: only the first line and the length of each block are sorted, and broadcast."""
    first = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(first), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = lines.join(F.broadcast(starts), ["_file", "_block"]).withColumn(ROW, F.col("_line") + F.col("_shift"))
    return out.drop("_file", "_block", "_line", "_shift").withMetadata(ROW, {"dense": True})


def read_csv_files(
    spark: SparkSession, path: str, header: bool = True, types: Mapping[int, str] | None = None, delimiter: str = ",",
    quote: str = '"', strict: bool = False, sample: int = SAMPLE_ROWS, multiline: bool = False, end_of_line: str | None = None,
    rows: bool = False,
) -> DataFrame:
    """A table from CSV files that Spark reads in parallel; the sample is the only thing that reaches the driver.

    Without a header a first pass finds the longest row, which gives the columns (records over several lines count by
    their lines). `rows` attaches the row order: files by path, lines as they stand in them.
    """
    line_ends = {"lineSep": end_of_line} if end_of_line else {}
    reader = spark.read.options(
        header=header, sep=delimiter, quote=quote, escape=quote, mode="FAILFAST" if strict else "PERMISSIVE",
        multiLine=multiline, inferSchema=False, emptyValue="", enforceSchema=True, **line_ends,
    )
    if not header:
        width = _longest_row(spark, path, delimiter, quote, line_ends)
        reader = reader.schema(T.StructType([T.StructField(f"col{n}", T.StringType()) for n in range(width)]))
    raw = reader.csv(path)
    names = raw.columns
    if rows:
        place = raw.metadataColumn("_metadata")
        raw = raw.withColumns({"_file": place["file_path"], "_block": place["file_block_start"], "_line": F.monotonically_increasing_id()})
        raw = _numbered(kept(raw, "csv-lines"))
    return _typed(raw, names, types, sample)


def _text_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").cast("string").alias(c) for c in columns(df)]


def format_csv(
    records: Iterable[Sequence[str | None]], delimiter: str = ",", quote: str = '"', end_of_line: str = "\n", force_quote: bool = False
) -> str:
    """Records of strings as CSV text, the reverse of parse_csv; None is empty."""
    out = io.StringIO()
    writer = csv.writer(
        out, delimiter=delimiter, quotechar=quote, lineterminator=end_of_line, quoting=csv.QUOTE_ALL if force_quote else csv.QUOTE_MINIMAL
    )
    writer.writerows(["" if v is None else v for v in record] for record in records)
    return out.getvalue()


def write_csv(df: DataFrame, delimiter: str = ",", quote: str = '"', end_of_line: str = "\n", force_quote: bool = False) -> str:
    """A small table as CSV text with a header, in row order; null is empty. For large tables see write_csv_files."""
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    records = ordered.select(*_text_columns(df)).toLocalIterator()
    return format_csv(chain([columns(df)], records), delimiter, quote, end_of_line, force_quote)


def write_csv_files(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', force_quote: bool = False) -> str:
    """The table as CSV files with headers, written in parallel; null and the empty string are both empty."""
    df.select(*_text_columns(df)).write.options(
        header=True, sep=delimiter, quote=quote, escape=quote, quoteAll=force_quote, nullValue="", emptyValue=""
    ).mode("overwrite").csv(path)
    return path
