import datetime as dt
from decimal import Decimal

import pytest

from tabula import types
from tabula.operators.ordering import sort_table
from tabula.operators.windows import lag
from tabula.plans.expr import c
from tabula.plans.query import avg, count, group_by, max_, min_, select, sum_, where
from tabula.sources.store import load_table, save_table
from tests.helpers import make, rows, unordered

D1, D2, D3 = dt.date(2020, 1, 1), dt.date(2020, 6, 15), dt.date(2021, 3, 10)


@pytest.fixture(autouse=True)
def cents():
    types.register_type(
        "cents", "i64", Decimal, lambda d: int(d.scaleb(2)), lambda n: Decimal(n).scaleb(-2)
    )


def test_registry():
    assert types.physical("date") == "i64" and types.encode("date", D1) == 18262 and types.decode("date", 18262) == D1
    assert types.encode("cents", Decimal("1.50")) == 150 and types.decode("cents", None) is None
    assert types.lookup("nothing") is None
    with pytest.raises(KeyError):
        types.codec("nothing")
    nanos = types.encode("duration", dt.timedelta(seconds=1))
    assert nanos == 10**9 and types.decode("duration", nanos) == dt.timedelta(seconds=1)
    stamp = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    assert types.decode("instant", types.encode("instant", stamp)) == stamp


def test_date_filter_and_group(spark):
    df = types.typed_column(spark, "d", "date", [D1, D2, D3])
    assert rows(where(df, c("d") > D2)) == [(D3,)]
    pairs = spark.createDataFrame([(D1, 10), (D1, 5), (D2, 7)], "d date, q long")
    out = select(pairs, "d", sum_("q"), count("q"))
    assert unordered(out) == sorted([(D1, 15, 2), (D2, 7, 1)], key=repr)
    out = group_by(pairs, ["q"], [min_("d", "lo"), sum_("d", "s"), avg("d", "a")])
    assert unordered(out)[0] == (10, D1, 18262, 18262.0)


def test_codec_survives_operators(spark, tmp_path):
    df = types.typed_column(spark, "price", "cents", [Decimal("2.25"), Decimal("1.50"), None])
    assert rows(df) == [(225,), (150,), (None,)]
    assert types.decoded(sort_table(df, [("price", "asc")]), "price") == [None, Decimal("1.50"), Decimal("2.25")]
    assert types.decoded(where(df, c("price") > Decimal("1.50")), "price") == [Decimal("2.25")]
    keyed = df.selectExpr("1 AS k", "price")
    keyed = keyed.withMetadata("price", {"logical": "cents"})
    top = group_by(keyed, ["k"], [max_("price", "top"), sum_("price", "total")])
    assert types.logical_of(top.schema["top"]) == "cents" and types.decoded(top, "top") == [Decimal("2.25")]
    assert types.logical_of(top.schema["total"]) is None
    moved = lag(df, "price", 1, Decimal("9.99"))
    assert types.decoded(moved, "lag") == [Decimal("9.99"), Decimal("2.25"), Decimal("1.50")]
    again = load_table(spark, save_table(df, str(tmp_path / "t")))
    assert types.decoded(again, "price") == [Decimal("2.25"), Decimal("1.50"), None]


def test_datetime_sums_are_encoded(spark):
    df = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '1970-01-01 00:00:01' AS t UNION ALL SELECT 1, TIMESTAMP_NTZ '1970-01-01 00:00:02'")
    assert rows(group_by(df, ["k"], [sum_("t", "s"), max_("t", "hi")])) == [(1, 3000, dt.datetime(1970, 1, 1, 0, 0, 2))]


def test_with_logical_clears(spark):
    df = make(spark, v=("i64", [1]))
    tagged = df.select(types.with_logical(df["v"], "v", "cents"))
    assert types.logical_of(tagged.schema["v"]) == "cents"
    assert types.logical_of(tagged.select(types.with_logical(tagged["v"], "v", None)).schema["v"]) is None
