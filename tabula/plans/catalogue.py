"""Ready-made queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula import types
from tabula.frame import array_column, col_idx, col_name, column, column_by_idx, ncols, nrows, slice_rows, table, with_rows
from tabula.functions import elementwise as el
from tabula.operators import batches, graph, ordering, reduce, selection, windows
from tabula.plans.expr import c, either, every
from tabula.plans.ordered import sort_plan, window_plan
from tabula.plans.query import Query, avg, count, filter_rows, group_by, mask, max_, min_, parallel_group_by, pivot, select, sum_, where
from tabula.session import parts_for, scratch
from tabula.sources import csvio, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """where, then select: the sum of large quantities by return flag."""
    busy = where(read(spark, sf_dir, "lineitem"), c("l_quantity") > 30)
    return select(busy, "l_returnflag", sum_("l_quantity").named("sum_l_quantity"))


def money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


def doubles(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


# Filters

LINE = "l_orderkey, l_linenumber, l_quantity"


@query(f"SELECT {LINE} FROM lineitem WHERE l_quantity > 30")
def where_cmp(spark, sf_dir):
    return where(read(spark, sf_dir, "lineitem"), c("l_quantity") > 30).select(*LINE.split(", "))


@query(f"SELECT {LINE} FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 AND l_returnflag = 'A'")
def where_and(spark, sf_dir):
    test = every(c("l_quantity") > 10, c("l_discount") < 0.05, c("l_returnflag") == "A")
    return where(read(spark, sf_dir, "lineitem"), test).select(*LINE.split(", "))


@query(f"SELECT {LINE} FROM lineitem WHERE l_quantity >= 45 OR l_linenumber <= 1 OR l_returnflag <> 'N'")
def where_or(spark, sf_dir):
    test = either(c("l_quantity") >= 45, c("l_linenumber") <= 1, c("l_returnflag") != "N")
    return where(read(spark, sf_dir, "lineitem"), test).select(*LINE.split(", "))


@query("SELECT event_id, value FROM events WHERE NOT coalesce(value > 50 AND NOT isnan(value), false)")
def where_not(spark, sf_dir):
    return where(read(spark, sf_dir, "events"), ~(c("value") > 50)).select("event_id", "value")


def holed_events(spark, sf_dir):
    """Events in which one type is null, and every seventh value is null."""
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "ts",
    )


HOLED = "(SELECT event_id, user_id, nullif(event_type, 'error') AS kind, CASE WHEN event_id % 7 <> 0 THEN value END AS value, ts FROM events)"


@query(f"SELECT event_id, kind FROM {HOLED} WHERE NOT coalesce(kind = 'click', false)")
def where_not_nulls(spark, sf_dir):
    return where(holed_events(spark, sf_dir), ~(c("kind") == "click")).select("event_id", "kind")


@query(f"SELECT event_id, kind FROM {HOLED} WHERE coalesce(kind <> 'click', false)")
def where_ne_nulls(spark, sf_dir):
    return where(holed_events(spark, sf_dir), c("kind") != "click").select("event_id", "kind")


@query(f"SELECT event_id FROM {HOLED} WHERE NOT (coalesce(value >= 20, false) AND coalesce(kind = 'view', false)) AND value IS NOT NULL")
def where_not_and(spark, sf_dir):
    test = ~((c("value") >= 20) & (c("kind") == "view")) & ~c("value").is_null()
    return where(holed_events(spark, sf_dir), test).select("event_id")


@query(f"SELECT event_id FROM {HOLED} WHERE value IS NULL")
def where_missing(spark, sf_dir):
    return where(holed_events(spark, sf_dir), c("value").is_null()).select("event_id")


@query(f"SELECT {LINE} FROM lineitem WHERE l_linenumber = 3")
def where_truncated_literal(spark, sf_dir):
    return where(read(spark, sf_dir, "lineitem"), c("l_linenumber") == 3.9).select(*LINE.split(", "))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01 00:00:00'")
def date_filter(spark, sf_dir):
    test = c("l_shipdate") > dt.datetime(1997, 1, 1)
    return where(read(spark, sf_dir, "lineitem"), test).select("l_orderkey", "l_linenumber", "l_shipdate")


@query(f"SELECT event_id, coalesce(value > 50, false) AS mask FROM {HOLED}")
def mask_column(spark, sf_dir):
    return mask(holed_events(spark, sf_dir), c("value") > 50).select("event_id", "mask")


@query(f"SELECT event_id FROM {HOLED} WHERE value > 50")
def mask_filter(spark, sf_dir):
    return filter_rows(mask(holed_events(spark, sf_dir), c("value") > 50)).select("event_id")


# Aggregation


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s, count(l_quantity) AS n,
  CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi, round(avg(CAST(l_quantity AS DECIMAL(18,2))), 6) AS mean
  FROM lineitem GROUP BY ALL""")
def group_five_aggregates(spark, sf_dir):
    items = [sum_("l_quantity", "s"), count("l_quantity", "n"), min_("l_quantity", "lo"), max_("l_quantity", "hi"), avg("l_quantity", "mean")]
    found = group_by(money(read(spark, sf_dir, "lineitem"), "l_quantity"), ["l_returnflag", "l_linestatus"], items)
    return doubles(found, "s", "lo", "hi", "mean")


@query("""SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem
  WHERE l_quantity > 25 GROUP BY l_suppkey""")
def group_fused_where(spark, sf_dir):
    lines = money(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return doubles(group_by(lines, ["l_suppkey"], [sum_("l_extendedprice", "total")], where=c("l_quantity") > 25), "total")


@query("""SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def group_many_keys(spark, sf_dir):
    lines = money(read(spark, sf_dir, "lineitem"), "l_quantity")
    return doubles(parallel_group_by(lines, ["l_orderkey"], [sum_("l_quantity", "total"), count("l_linenumber", "n")], n_threads=8), "total")


@query(f"SELECT kind, count(value) AS n, CAST(count(*) AS BIGINT) AS rows FROM {HOLED} GROUP BY kind")
def group_null_key(spark, sf_dir):
    return group_by(holed_events(spark, sf_dir), ["kind"], [count("value", "n"), count("event_id", "rows")])


@query("""SELECT l_linenumber, CAST(coalesce(sum(v), 0) AS BIGINT) AS s, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM
  (SELECT l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_suppkey END AS v FROM lineitem) GROUP BY l_linenumber""")
def group_all_null(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")).alias("v"))
    items = [sum_("v", "s"), count("v", "n"), min_("v", "lo"), max_("v", "hi"), avg("v", "mean")]
    return group_by(lines, ["l_linenumber"], items)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_keys(spark, sf_dir):
    return select(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT k, count(*) AS n FROM (SELECT CASE WHEN isnan(x) THEN NULL ELSE x END AS k FROM
  (SELECT CASE WHEN event_id % 3 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 3 = 1 THEN NULL ELSE 1.5 END AS x FROM events)) GROUP BY k""")
def group_nan_key(spark, sf_dir):
    third = F.col("event_id") % 3
    keyed = read(spark, sf_dir, "events").select(
        F.when(third == 0, F.lit(float("nan"))).when(third == 2, F.lit(1.5)).alias("k"), F.lit(1).cast("long").alias("one")
    )
    return group_by(keyed, ["k"], [count("one", "n")])


@query("SELECT l_returnflag, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, count(l_shipdate) AS n FROM lineitem GROUP BY l_returnflag")
def date_min_max(spark, sf_dir):
    items = [min_("l_shipdate", "first_day"), max_("l_shipdate", "last_day"), count("l_shipdate", "n")]
    return group_by(read(spark, sf_dir, "lineitem"), ["l_returnflag"], items)


@query("""SELECT CAST(coalesce(sum(l_suppkey), 0) AS BIGINT) AS s, count(l_suppkey) AS n, min(l_suppkey) AS lo, max(l_suppkey) AS hi,
  round(avg(l_suppkey), 6) AS mean FROM lineitem""")
def scalar_aggregates(spark, sf_dir):
    items = [sum_("l_suppkey", "s"), count("l_suppkey", "n"), min_("l_suppkey", "lo"), max_("l_suppkey", "hi"), avg("l_suppkey", "mean")]
    return doubles(reduce.reduce(read(spark, sf_dir, "lineitem"), *items), "mean")


@query("""SELECT CAST(coalesce(sum(l_suppkey), 0) AS BIGINT) AS s, count(l_suppkey) AS n, max(l_suppkey) AS hi FROM lineitem WHERE l_suppkey < 0""")
def scalar_of_nothing(spark, sf_dir):
    none = where(read(spark, sf_dir, "lineitem"), c("l_suppkey") < 0)
    return reduce.reduce(none, sum_("l_suppkey", "s"), count("l_suppkey", "n"), max_("l_suppkey", "hi"))


@query(f"SELECT count(*) FILTER (value > 50) AS n FROM {HOLED}")
def filter_count(spark, sf_dir):
    events = holed_events(spark, sf_dir)
    return events.agg(F.count_if((c("value") > 50).compile(events.schema)).alias("n"))


# Pivots

FLAGS = ("A", "N", "R")


def _pivot_sql(cell: str, source: str = "lineitem", row: str = "l_linestatus", head: str = "l_returnflag", heads=FLAGS) -> str:
    cells = ", ".join(
        f"CASE WHEN count(*) FILTER ({head} = '{h}') > 0 THEN {cell.format(f'FILTER ({head} = ' + chr(39) + h + chr(39) + ')')} END AS \"{h}\""
        for h in heads
    )
    return f"SELECT {row}, {cells} FROM {source} GROUP BY {row}"


@query(_pivot_sql("CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) {} AS DOUBLE)"))
def pivot_sum(spark, sf_dir):
    found = pivot(money(read(spark, sf_dir, "lineitem"), "l_quantity"), "l_linestatus", "l_returnflag", "l_quantity", "sum", FLAGS)
    return doubles(found, *FLAGS)


@query(_pivot_sql("count(l_quantity) {}"))
def pivot_count(spark, sf_dir):
    return pivot(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", "count")


@query(_pivot_sql("min(l_suppkey) {}"))
def pivot_min(spark, sf_dir):
    return pivot(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_suppkey", "min")


@query(_pivot_sql("max(l_suppkey) {}"))
def pivot_max(spark, sf_dir):
    return pivot(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_suppkey", "max")


@query(_pivot_sql("round(avg(l_suppkey) {}, 6)"))
def pivot_avg(spark, sf_dir):
    return doubles(pivot(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_suppkey", "avg"), *FLAGS)


@query("""SELECT kind, count(event_id) FILTER (part = 0) AS "0", count(event_id) FILTER (part = 1) AS "1",
  CASE WHEN count(*) FILTER (part IS NULL) > 0 THEN count(event_id) FILTER (part IS NULL) END AS __null__ FROM
  (SELECT kind, event_id, CASE WHEN kind IS NOT NULL OR event_id % 2 = 0 THEN nullif(event_id % 3, 2) ELSE 0 END AS part FROM """ + HOLED + ") GROUP BY kind")
def pivot_null_column(spark, sf_dir):
    part = F.when(F.col("kind").isNotNull() | (F.col("event_id") % 2 == 0), F.nullif(F.col("event_id") % 3, F.lit(2).cast("long"))).otherwise(0)
    return pivot(holed_events(spark, sf_dir).withColumn("part", part), "kind", "part", "event_id", "count", [0, 1, None])


# Sorts and windows


def lines_in_order(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return with_rows(lines, [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS position FROM lineitem""")
def sort_rownum(spark, sf_dir):
    sorted_lines = ordering.sort_table(lines_in_order(spark, sf_dir), [("l_quantity", "desc")])
    return windows.row_number(sorted_lines, "position").select("l_orderkey", "l_linenumber", "l_quantity", "position")


@query(f"""SELECT event_id, row_number() OVER (ORDER BY kind NULLS FIRST, value DESC NULLS FIRST, event_id) AS position FROM {HOLED}""")
def sort_nulls(spark, sf_dir):
    events = events_in_order(spark, sf_dir)
    sorted_events = ordering.sort_table(events, [("kind", "asc"), ("value", "desc")])
    return windows.row_number(sorted_events, "position").select("event_id", "position")


def events_in_order(spark, sf_dir):
    return with_rows(holed_events(spark, sf_dir), [F.col("event_id")])


@query(f"""SELECT row_number() OVER (ORDER BY kind DESC NULLS LAST, user_id, event_id) - 1 AS position,
  row_number() OVER (ORDER BY event_id) - 1 AS row FROM {HOLED}""")
def sort_index(spark, sf_dir):
    return ordering.sort_index_by(events_in_order(spark, sf_dir), [("kind", "desc"), ("user_id", "asc")])


@query("""SELECT l_orderkey, l_linenumber, n - 1 AS place FROM (SELECT l_orderkey, l_linenumber,
  row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS n FROM lineitem)""")
def gather_by_index(spark, sf_dir):
    lines = lines_in_order(spark, sf_dir)
    moved = ordering.gather(lines, ordering.sort_index_by(lines, [("l_quantity", "asc")]))
    return moved.select("l_orderkey", "l_linenumber", F.col(ordering.ROW).alias("place"))


@query("""SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) AS rank, dense_rank() OVER (ORDER BY l_quantity) AS dense FROM lineitem""")
def rank_sorted(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    order = [F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    return windows.ranks(lines, "l_quantity", "rank", "dense", order).select("l_orderkey", "l_linenumber", "rank", "dense")


@query(f"""WITH runs AS (SELECT event_id, row_number() OVER w AS n,
    kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 AS new FROM {HOLED} WINDOW w AS (ORDER BY event_id))
  SELECT event_id, max(CASE WHEN new THEN n END) OVER (ORDER BY n) AS rank,
    CAST(sum(CAST(new AS BIGINT)) OVER (ORDER BY n) AS BIGINT) AS dense FROM runs""")
def rank_runs(spark, sf_dir):
    ranked = windows.rank(events_in_order(spark, sf_dir), "kind")
    return windows.dense_rank(ranked, "kind", "dense").select("event_id", "rank", "dense")


@query("""SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rank FROM lineitem""")
def rank_partitioned(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    order = [F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    return windows.rank(lines, "l_quantity", order=order, partition_by=["l_suppkey"]).select("l_orderkey", "l_linenumber", "rank")


@query(f"""SELECT event_id, lag(user_id, 2, -1) OVER w AS back, lead(user_id, 1) OVER w AS ahead
  FROM {HOLED} WINDOW w AS (ORDER BY event_id)""")
def lag_lead(spark, sf_dir):
    moved = windows.lag(events_in_order(spark, sf_dir), "user_id", 2, -1, "back")
    return windows.lead(moved, "user_id", 1, None, "ahead").select("event_id", "back", "ahead")


@query(f"SELECT event_id, lag(value, 1, 0.0) OVER (ORDER BY event_id) AS before FROM {HOLED}")
def lag_over_nulls(spark, sf_dir):
    events = events_in_order(spark, sf_dir)
    return windows.lag(events, "value", 1, 0.0, "before").select("event_id", "before")


@query(f"""SELECT event_id, lag(value, 1, 0.0) OVER w AS back FROM {HOLED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def lag_partitioned(spark, sf_dir):
    return windows.lag(holed_events(spark, sf_dir), "value", 1, 0.0, "back", [F.col("event_id")], ["user_id"]).select("event_id", "back")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
  WHERE n BETWEEN 101 AND 150""")
def row_slice(spark, sf_dir):
    return slice_rows(lines_in_order(spark, sf_dir), 100, 50).select("l_orderkey", "l_linenumber")


# Element-wise functions


@query("""SELECT l_orderkey, l_linenumber, l_orderkey + l_suppkey AS added, l_orderkey - l_suppkey AS less, l_orderkey * l_suppkey AS times,
  -l_suppkey AS neg, abs(l_suppkey - 50) AS mag FROM lineitem""")
def arith_i64(spark, sf_dir):
    a, b = F.col("l_orderkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", el.i64_add(a, b).alias("added"), el.i64_sub(a, b).alias("less"), el.i64_mul(a, b).alias("times"),
        el.i64_neg(b).alias("neg"), el.i64_abs(b - 50).alias("mag"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS added, round(l_quantity - l_tax, 6) AS less,
  round(l_quantity * l_tax, 6) AS times, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS parts,
  -l_quantity AS neg, abs(l_tax - 0.04) AS mag FROM lineitem""")
def arith_f64(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax")
    found = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", el.f64_add(q, t).alias("added"), el.f64_sub(q, t).alias("less"), el.f64_mul(q, t).alias("times"),
        el.f64_div(q, F.col("l_discount")).alias("parts"), el.f64_neg(q).alias("neg"), el.f64_abs(t - 0.04).alias("mag"),
    )
    return doubles(found, "added", "less", "times", "parts")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE round(CAST(l_orderkey AS DOUBLE) / (l_linenumber - 1), 6) END AS parts
  FROM lineitem""")
def arith_i64_div(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", el.i64_div(F.col("l_orderkey"), F.col("l_linenumber") - 1).alias("parts")
    )
    return doubles(found, "parts")


@query("""SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN -9223372036854775808 + event_id ELSE event_id + 5 END AS BIGINT) AS wrapped FROM events""")
def arith_wrapping(spark, sf_dir):
    other = F.when(F.col("event_id") % 2 == 0, F.lit(2**63 - 1)).otherwise(F.lit(4).cast("long"))
    return read(spark, sf_dir, "events").select("event_id", el.parallel_i64_add(F.col("event_id") + 1, other).alias("wrapped"))


@query(f"""SELECT event_id, coalesce(value = user_id, false) AS eq, coalesce(value <> user_id, false) AS ne, coalesce(value < user_id, false) AS lt,
  coalesce(value <= user_id, false) AS le, coalesce(value > user_id, false) AS gt, coalesce(value >= user_id, false) AS ge FROM {HOLED}""")
def compare_columns(spark, sf_dir):
    a, b = F.col("value"), F.col("user_id").cast("double")
    tests = {"eq": el.f64_eq, "ne": el.f64_ne, "lt": el.f64_lt, "le": el.f64_le, "gt": el.f64_gt, "ge": el.f64_ge}
    return holed_events(spark, sf_dir).select("event_id", *[f(a, b).alias(n) for n, f in tests.items()])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey = l_linenumber AS eq, l_suppkey < l_linenumber AS lt, l_suppkey >= l_linenumber AS ge FROM lineitem""")
def compare_i64(spark, sf_dir):
    a, b = F.col("l_suppkey"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", el.i64_eq(a, b).alias("eq"), el.i64_lt(a, b).alias("lt"), el.i64_ge(a, b).alias("ge")
    )


@query("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS kinds FROM lineitem")
def hash_rows(spark, sf_dir):
    hashed = read(spark, sf_dir, "lineitem").select(el.hash_row(F.col("l_orderkey"), F.col("l_linenumber")).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("h").alias("kinds"))


# Sources, selections, batches


@query(f"SELECT {LINE}, l_returnflag FROM lineitem")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    csvio.write_csv_files(read(spark, sf_dir, "lineitem").select(*LINE.split(", "), "l_returnflag"), path)
    return csvio.read_csv_files(spark, path).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def store_round_trip(spark, sf_dir):
    path = scratch(spark, "store")
    store.save_table(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return store.load_table(spark, path)


@query("""WITH n AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 1024 AS block, value FROM """ + HOLED + """),
  b AS (SELECT block, count(*) AS rows, count(*) FILTER (value > 50) AS live FROM n GROUP BY block)
  SELECT block, rows, live, CASE WHEN live = 0 THEN 'dead' WHEN live = rows THEN 'live' ELSE 'mixed' END AS flag,
  CAST(coalesce(sum(live) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b""")
def selection_blocks(spark, sf_dir):
    events = events_in_order(spark, sf_dir)
    return selection.live_by_block(events, c("value") > 50)


@query("SELECT l_orderkey, l_linenumber, l_suppkey * 2 AS twice FROM lineitem")
def batch_map(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def twice(batch):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pc.multiply(batch.column(2), 2)], ["l_orderkey", "l_linenumber", "twice"]
        )

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return batches.map_batches(lines, twice, "l_orderkey long, l_linenumber int, twice long")


@query("""SELECT 'select' AS type, count(*) AS n_rows, 3 AS referenced, 11 AS total, true AS predicate, 1 AS keys, 1 AS aggs FROM lineitem""")
def plan_analysis(spark, sf_dir):
    found = Query(read(spark, sf_dir, "lineitem"), ("l_returnflag",), (sum_("l_quantity"),), c("l_discount") > 0.05).analyze()
    return spark.createDataFrame([tuple(found.values())], "type string, n_rows long, referenced int, total int, predicate boolean, keys int, aggs int")


@query("""SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag""")
def plan_run(spark, sf_dir):
    lines = money(read(spark, sf_dir, "lineitem"), "l_quantity")
    found = Query(lines, ("l_returnflag",), (sum_("l_quantity", "total"),), c("l_discount") > 0.05)
    return doubles(found.run(), "total")


# Functions on columns, tables and plans that the queries above leave out


@query("""SELECT l_orderkey, l_linenumber, l_suppkey <> l_linenumber AS ne, l_suppkey <= l_linenumber AS le, l_suppkey > l_linenumber AS gt FROM lineitem""")
def compare_i64_rest(spark, sf_dir):
    a, b = F.col("l_suppkey"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", el.i64_ne(a, b).alias("ne"), el.i64_le(a, b).alias("le"), el.i64_gt(a, b).alias("gt")
    )


@query(f"""SELECT CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi,
  round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value), 6) AS mean FROM {HOLED}""")
def scalar_aggregates_f64(spark, sf_dir):
    events = holed_events(spark, sf_dir)
    items = [sum_("value", "s"), count("value", "n"), min_("value", "lo"), max_("value", "hi"), avg("value", "mean")]
    return doubles(reduce.reduce(events, *items), "s", "mean")


@query(f"""SELECT count(DISTINCT user_id) AS ints, count(DISTINCT value) AS floats, count(DISTINCT (user_id, event_id)) AS pairs,
  true AS zeros_alike, true AS nan_like_null, true AS ordered FROM {HOLED}""")
def hash_values(spark, sf_dir):
    h = holed_events(spark, sf_dir).select(
        el.hash_i64(F.col("user_id")).alias("i"), F.when(F.col("value").isNotNull(), el.hash_f64(F.col("value"))).alias("f"),
        el.hash_combine(F.col("user_id"), F.col("event_id")).alias("p"),
    )
    same = [
        el.hash_f64(F.lit(0.0)) == el.hash_f64(F.lit(-0.0)), el.hash_f64(F.lit(float("nan"))) == el.hash_f64(F.lit(None).cast("double")),
        el.hash_combine(F.lit(1), F.lit(2)) != el.hash_combine(F.lit(2), F.lit(1)),
    ]
    found = h.agg(F.count_distinct("i").alias("ints"), F.count_distinct("f").alias("floats"), F.count_distinct("p").alias("pairs"))
    return found.select("*", *[t.alias(n) for t, n in zip(same, ("zeros_alike", "nan_like_null", "ordered"))])


@query("""SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey / 4 AS DOUBLE) AS f, n_nationkey % 2 = 0 AS b, n_name AS y,
  nullif(n_name, 'n7') AS s, CAST(n_nationkey * 3 AS BIGINT) AS a FROM nation""")
def columns_of_values(spark, sf_dir):
    """The constructors of columns take values at hand: those of the 25 nations."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()
    keys, names = [r[0] for r in rows], [r[1] for r in rows]
    made = table(spark, [
        ("i", "i64", keys), ("f", "f64", [k / 4 for k in keys]), ("b", "bool", [k % 2 == 0 for k in keys]), ("y", "sym", names),
        ("s", "str", [None if n == "n7" else n for n in names]),
    ])
    arrayed = array_column(spark, "a", "i64", np.array(keys) * 3)
    return made.join(arrayed, ordering.ROW).select("i", "f", "b", "y", "s", "a")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS k, DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS day,
  epoch_ms(TIMESTAMP '2024-01-01 00:00:00' + to_hours(n_nationkey)) AS instant_ms,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_nationkey) AS clock, CAST(n_nationkey AS BIGINT) * 1000000000 AS nanos,
  'duration' AS logical, true AS decodes, true AS cleared FROM nation""")
def columns_of_logical_types(spark, sf_dir):
    """Dates, instants, datetimes and durations of values at hand, and the logical type that a column carries."""
    first = dt.datetime(2024, 1, 1)
    keys = [r[0] for r in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    spans = [dt.timedelta(seconds=k) for k in keys]
    made = {
        "day": ("date", [first.date() + dt.timedelta(days=k) for k in keys]),
        "instant": ("instant", [first.replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=k) for k in keys]),
        "clock": ("datetime", [first + dt.timedelta(minutes=k) for k in keys]), "nanos": ("duration", spans),
    }
    parts = {name: types.typed_column(spark, name, tag, values) for name, (tag, values) in made.items()}
    whole = table(spark, [("k", "i64", keys)])
    for part in parts.values():
        whole = whole.join(part, ordering.ROW)
    plain = whole.select(types.with_logical(F.col("nanos"), "nanos", None))
    return whole.select(
        "k", "day", F.unix_millis("instant").alias("instant_ms"), "clock", "nanos", F.lit(types.logical_of(whole.schema["nanos"])).alias("logical"),
        F.lit(types.decoded(parts["nanos"], "nanos") == spans).alias("decodes"), F.lit(types.logical_of(plain.schema["nanos"]) is None).alias("cleared"),
    )


@query("""SELECT 3 AS width, count(*) AS n, 1 AS place, -1 AS missing, 'value' AS third, count(value) AS held, count(user_id) AS by_place FROM """ + HOLED)
def table_accessors(spark, sf_dir):
    events = with_rows(holed_events(spark, sf_dir).select("event_id", "user_id", "value"))
    held = column(events, "value").agg(F.count("value").alias("held"))
    by_place = column_by_idx(events, 1).agg(F.count("user_id").alias("by_place"))
    facts = spark.createDataFrame(
        [(ncols(events), nrows(events), col_idx(events, "user_id"), col_idx(events, "none"), col_name(events, 2))],
        "width int, n long, place int, missing int, third string",
    )
    return facts.join(held).join(by_place)


@query("""SELECT CAST(row AS BIGINT) AS row, row NOT IN (3, 1024, 5000) AS live, (SELECT count(*) - 3 FROM range(8000)) AS total,
  CASE WHEN row // 1024 IN (0, 1, 4) THEN 'mixed' ELSE 'live' END AS flag, 1023 AS first_block, true AS others_dead
  FROM (VALUES (3), (4), (1024), (7777)) AS v(row)""")
def selection_edits(spark, sf_dir):
    some = selection.selection_all(8000)
    for row in (3, 4, 1024, 5000):
        some = some.set_row(row, False)
    some = some.set_row(4, True)
    rows = [
        (r, some.row_live(r), some.popcount(), some.block_flag(r // selection.BLOCK_ROWS), some.block_popcount(0), selection.selection_none(9).popcount() == 0)
        for r in (3, 4, 1024, 7777)
    ]
    return spark.createDataFrame(rows, "row long, live boolean, total long, flag string, first_block int, others_dead boolean")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events) WHERE row NOT IN (3, 100, 500)""")
def selection_applied(spark, sf_dir):
    events = events_in_order(spark, sf_dir)
    some = selection.selection_all(events.count())
    for row in (3, 100, 500):
        some = some.set_row(row, False)
    return some.apply(events).select("event_id")


@query(f"""SELECT event_id, value * 2 AS twice, NOT (value > 50) AS low, upper(kind) AS loud FROM {HOLED}""")
def batch_map_kinds(spark, sf_dir):
    """Batches of floating, boolean and string columns."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def change(batch):
        made = [batch.column(0), pc.multiply(batch.column(1), 2.0), pc.invert(batch.column(2)), pc.utf8_upper(batch.column(3))]
        return pa.RecordBatch.from_arrays(made, ["event_id", "twice", "low", "loud"])

    events = holed_events(spark, sf_dir).select("event_id", "value", (F.col("value") > 50).alias("low"), "kind")
    return batches.map_batches(events, change, "event_id long, twice double, low boolean, loud string")


@query("""SELECT n_nationkey AS k, n_name || ' says "hi", twice' || chr(10) || 'over' AS said, n_nationkey % 2 = 0 AS even FROM nation""")
def csv_text_round_trip(spark, sf_dir):
    """Quotes, delimiters and line ends inside cells, booleans and strict parsing, as text at hand."""
    said = F.concat("n_name", F.lit(' says "hi", twice\nover'))
    nations = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"), said.alias("said"), (F.col("n_nationkey") % 2 == 0).alias("even")
    )
    again = csvio.read_csv(spark, csvio.write_csv(nations, delimiter=";", force_quote=True), delimiter=";", strict=True)
    return again.select(F.col("k").cast("int").alias("k"), "said", "even")


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name || '|"x"' AS name FROM region""")
def csv_records(spark, sf_dir):
    """Records of strings in and out of text, nothing inferred."""
    records = [(str(r[0]), r[1] + '|"x"') for r in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]
    found = csvio.parse_csv(csvio.format_csv(records, delimiter="|"), delimiter="|", strict=True)
    return spark.createDataFrame(found, "k string, name string")


@query("""SELECT n - 1 AS line, l_orderkey, l_linenumber FROM
  (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)""")
def csv_files_in_order(spark, sf_dir):
    path = scratch(spark, "csv-ordered")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber")
    csvio.write_csv_files(lines, path)
    found = csvio.read_csv_files(spark, path, rows=True)
    return found.select(F.col(ordering.ROW).alias("line"), "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


@query("""SELECT 'l_discount' AS predicate, 'l_quantity,l_discount,l_returnflag' AS referenced, true AS pruned, true AS pushed, true AS folded""")
def plan_rewrites(spark, sf_dir):
    """What Catalyst makes of a query: columns pruned and the predicate pushed into the scan, constants folded."""
    limit = (c("l_discount") > 0.05) & (c("l_discount") > 0.02 + 0.02)
    found = Query(read(spark, sf_dir, "lineitem"), ("l_returnflag",), (sum_("l_quantity"),), limit)
    text = found.explain()
    row = (
        ",".join(sorted(found.predicate_columns())), ",".join(found.referenced_columns()), "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in text,
        "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)" in text, "0.02 +" not in text,
    )
    return spark.createDataFrame([row], "predicate string, referenced string, pruned boolean, pushed boolean, folded boolean")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber) - 1 AS place,
  'l_quantity' AS read FROM lineitem""")
def plan_sort(spark, sf_dir):
    planned = sort_plan(lines_in_order(spark, sf_dir), [("l_quantity", "desc")])
    return planned.run().select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col(ordering.ROW).alias("place"), F.lit(",".join(planned.referenced_columns())).alias("read")
    )


@query(f"""SELECT event_id, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id) AS back, 'user_id,value' AS read FROM {HOLED}""")
def plan_window(spark, sf_dir):
    planned = window_plan(
        events_in_order(spark, sf_dir), "lag", "value", default=0.0, out="back", order=[F.col("event_id")], partition_by=["user_id"]
    )
    return planned.run().select("event_id", "back", F.lit(",".join(planned.referenced_columns())).alias("read"))


# Graphs. Every order leads from its customer to another one, so that nodes are the customers and all orders count.

ORDER_SIZE = "(SELECT CAST(max(o_custkey) + 1 AS BIGINT) AS n FROM orders)"
EDGES = f"(SELECT DISTINCT o_custkey AS src, (o_orderkey * 7919) % n AS dst FROM orders, {ORDER_SIZE})"
NODES = f"(SELECT unnest(range(n)) AS node FROM {ORDER_SIZE})"
START = "(SELECT CAST(min(o_custkey) AS BIGINT) FROM orders)"
WEIGHT = "CAST(1 + (src * 31 + dst * 17) % 7 AS DOUBLE)"


def degree_sql(edges: str, nodes: str, end: str, out: str) -> str:
    return f"SELECT node, coalesce(n, 0) AS {out} FROM {nodes} LEFT JOIN (SELECT {end}, count(*) AS n FROM {edges} GROUP BY {end}) ON node = {end}"


def paths_sql(edges: str, nodes: str, start: str, cost: str, zero: str) -> str:
    """Shortest paths: a node's distance is replaced while a shorter one turns up."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, {cost} AS w FROM {edges}),
  r(node, d) USING KEY (node) AS (SELECT {start} AS node, {zero} AS d UNION
    SELECT dst, min(r.d + w) FROM r JOIN e ON src = r.node LEFT JOIN recurring.r AS old ON old.node = dst
    GROUP BY dst, old.d HAVING old.d IS NULL OR min(r.d + w) < old.d)
  SELECT n.node, d AS distance FROM {nodes} n LEFT JOIN r ON r.node = n.node"""


def components_sql(edges: str, nodes: str) -> str:
    """The smallest label spreads over edges in both directions while it lowers any."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}),
  r(node, c) USING KEY (node) AS (SELECT node, node AS c FROM {nodes} UNION
    SELECT dst, min(r.c) FROM r JOIN e ON src = r.node JOIN recurring.r AS old ON old.node = dst
    GROUP BY dst, old.c HAVING min(r.c) < old.c)
  SELECT node, c AS component FROM r"""


def pagerank_sql(edges: str, nodes: str, rounds: int) -> str:
    steps = "".join(
        f""",
r{k + 1} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * ((SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM e)) / n
    + coalesce(got, 0)) AS rank FROM v, size LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM r{k} JOIN e ON src = node GROUP BY dst)
    ON node = dst)"""
        for k in range(rounds)
    )
    return f"""WITH e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS out FROM {edges}),
v AS MATERIALIZED (SELECT node FROM {nodes}), size AS (SELECT count(*)::DOUBLE AS n FROM v),
r0 AS (SELECT node, 1 / n AS rank FROM v, size){steps}
SELECT node, round(rank, 9) AS rank FROM r{rounds}"""


def order_graph(spark, sf_dir) -> graph.Graph:
    orders = read(spark, sf_dir, "orders")
    n = orders.agg(F.max("o_custkey")).first()[0] + 1
    edges = (
        orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7919 % n).alias("dst")).distinct()
        .withColumn("weight", (1 + (F.col("src") * 31 + F.col("dst") * 17) % 7).cast("double"))
        .withColumn(ordering.ROW, F.col("src") * n + F.col("dst"))
    )
    return graph.build_graph(edges, weight="weight", n_nodes=n)


def first_customer(spark, sf_dir) -> int:
    return read(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]


@query(degree_sql(EDGES, NODES, "src", "degree"))
def graph_degree(spark, sf_dir):
    return graph.degree(order_graph(spark, sf_dir))


@query(degree_sql(EDGES, NODES, "dst", "in_degree"))
def graph_in_degree(spark, sf_dir):
    return graph.in_degree(order_graph(spark, sf_dir))


@query(f"SELECT dst AS target, {WEIGHT} AS weight FROM {EDGES} WHERE src = {START}")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(order_graph(spark, sf_dir), first_customer(spark, sf_dir)).select("target", "weight")


@query(paths_sql(EDGES, NODES, START, "1", "0::BIGINT"))
def graph_bfs(spark, sf_dir):
    return graph.bfs(order_graph(spark, sf_dir), first_customer(spark, sf_dir))


@query(paths_sql(EDGES, NODES, START, WEIGHT, "0::DOUBLE"))
def graph_dijkstra(spark, sf_dir):
    return graph.dijkstra(order_graph(spark, sf_dir), first_customer(spark, sf_dir))


@query(components_sql(EDGES, NODES))
def graph_components(spark, sf_dir):
    return graph.connected_components(order_graph(spark, sf_dir))


@query(pagerank_sql(EDGES, NODES, 5))
def graph_pagerank(spark, sf_dir):
    return doubles(graph.pagerank(order_graph(spark, sf_dir), iters=5), "rank", digits=9)


@query(None)
def graph_dfs(spark, sf_dir):
    """Compared with a recursive search in the tests: SQL has no stack."""
    return graph.dfs(order_graph(spark, sf_dir), first_customer(spark, sf_dir))


# The same algorithms over every row: customers, orders and suppliers in one range of nodes, from customer to order and
# from order to supplier

ALL_SIZES = """(SELECT (SELECT max(o_custkey) + 1 FROM orders) AS c,
  greatest((SELECT max(o_orderkey) + 1 FROM orders), (SELECT max(l_orderkey) + 1 FROM lineitem)) AS o,
  (SELECT max(l_suppkey) + 1 FROM lineitem) AS s)"""
ALL_EDGES = f"""(SELECT o_custkey AS src, c + o_orderkey AS dst FROM orders, {ALL_SIZES}
  UNION SELECT c + l_orderkey, c + o + l_suppkey FROM lineitem, {ALL_SIZES})"""
ALL_NODES = f"(SELECT unnest(range(CAST(c + o + s AS BIGINT))) AS node FROM {ALL_SIZES})"


def whole_graph(spark, sf_dir) -> graph.Graph:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    ends = orders.agg(F.max("o_custkey").alias("c"), F.max("o_orderkey").alias("o"), F.count(F.lit(1)).alias("n")).first()
    more = lines.agg(F.max("l_orderkey").alias("o"), F.max("l_suppkey").alias("s"), F.count(F.lit(1)).alias("n")).first()
    first_order = ends["c"] + 1
    first_supplier = first_order + max(ends["o"], more["o"]) + 1
    edges = (
        orders.select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") + first_order).cast("long").alias("dst"))
        .unionByName(lines.select(
            (F.col("l_orderkey") + first_order).cast("long").alias("src"), (F.col("l_suppkey") + first_supplier).cast("long").alias("dst")
        ))
        .repartition(parts_for(spark, ends["n"] + more["n"]), "src", "dst").distinct()
        .withColumn("weight", (1 + (F.col("src") * 31 + F.col("dst") * 17) % 7).cast("double"))
    )
    return graph.build_graph(edges, weight="weight", n_nodes=first_supplier + more["s"] + 1)


@query(degree_sql(ALL_EDGES, ALL_NODES, "src", "degree"))
def graph_all_degree(spark, sf_dir):
    return graph.degree(whole_graph(spark, sf_dir))


@query(degree_sql(ALL_EDGES, ALL_NODES, "dst", "in_degree"))
def graph_all_in_degree(spark, sf_dir):
    return graph.in_degree(whole_graph(spark, sf_dir))


@query(f"SELECT dst AS target, {WEIGHT} AS weight FROM {ALL_EDGES} WHERE src = {START}")
def graph_all_neighbors(spark, sf_dir):
    return graph.neighbors(whole_graph(spark, sf_dir), first_customer(spark, sf_dir)).select("target", "weight")


@query(paths_sql(ALL_EDGES, ALL_NODES, START, "1", "0::BIGINT"))
def graph_all_bfs(spark, sf_dir):
    return graph.bfs(whole_graph(spark, sf_dir), first_customer(spark, sf_dir))


@query(paths_sql(ALL_EDGES, ALL_NODES, START, WEIGHT, "0::DOUBLE"))
def graph_all_dijkstra(spark, sf_dir):
    return graph.dijkstra(whole_graph(spark, sf_dir), first_customer(spark, sf_dir))


@query(components_sql(ALL_EDGES, ALL_NODES))
def graph_all_components(spark, sf_dir):
    return graph.connected_components(whole_graph(spark, sf_dir))


@query(pagerank_sql(ALL_EDGES, ALL_NODES, 5))
def graph_all_pagerank(spark, sf_dir):
    return doubles(graph.pagerank(whole_graph(spark, sf_dir), iters=5), "rank", digits=9)
