import datetime
import math

import pytest
from pyspark.sql import functions as F

from tablelab.functions import columns as C
from tablelab.operators import cleaning, profile


@pytest.fixture(scope="module")
def trips(spark):
    rows = [("t1", 3.5, "bus"), ("t2", None, "tram"), ("t3", 9.0, None), ("t3", 9.0, None), ("t4", 5.5, "bus"), ("t5", 4.0, "bus")]
    return spark.createDataFrame(rows, "`Trip/ID` string, `Fare (EUR)` double, mode string")


def test_accepted_steps_change_the_rows_and_the_log(trips):
    offered = [r["id"] for r in profile.cleaning_proposal(trips).collect()]
    accepted = ["fill_missing::Fare (EUR)", "drop_duplicates", "fill_missing::mode", "normalize_columns"]
    assert set(accepted) <= set(offered)
    done = cleaning.apply_cleaning(trips, accepted)
    got = {r["trip_id"]: (r["fare_eur"], r["mode"]) for r in done.data.collect()}
    assert got == {"t1": (3.5, "bus"), "t2": (4.75, "tram"), "t3": (9.0, "bus"), "t4": (5.5, "bus"), "t5": (4.0, "bus")}
    assert done.data.count() == 5 and done.log().count() == len(accepted)


def test_roles(trips, spark):
    assert [tuple(r) for r in profile.recommend_roles(trips).collect()] == [("Fare (EUR)", "target")]
    df = spark.createDataFrame([(1, 2.0, True, "x")], "a int, b double, c boolean, d string")
    assert profile.default_roles(df) == ("b", ["a"])
    assert profile.default_roles(df.select("d")) == ("", [])


def test_names(spark):
    names = [" Sales-Value $ 区域", "a", "a", "a_2", "", "--", "x__y_", "Ümlaut/ß", "tab\there"]
    assert C.normalize_names(names) == ["sales_value_区域", "a", "a_2", "a_2_2", "column", "column_2", "x_y", "ümlaut_ß", "tab_here"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(C.normalize_name_expr(F.col("n"))).collect()]
    assert got == [C.normalize_names([n])[0] for n in names]


def test_parse_number(spark):
    cases = {
        "1": 1.0, " 12 ": 12.0, "1e3": 1000.0, "+.5": 0.5, "2.": 2.0, "1,234": 1234.0, "-inf": -math.inf, "Infinity": math.inf,
        "1d": None, "1f": None, "0x1p3": None, "nan": None, "": None, "1 2": None, "１": None, "\t7\n": 7.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = [r[0] for r in df.select(C.parse_grouped_number(F.col("t"))).collect()]
    assert got == list(cases.values())


def test_profile_counts(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 0.0, "a", True), (2**53 + 1, -0.0, "a", None), (2**53, nan, None, False), (None, None, "空值", True)],
        "w bigint, d double, s string, b boolean",
    )
    got = {r["name"]: (r["missing"], r["unique"], r["numeric"]) for r in profile.profile_columns(df).collect()}
    assert got == {"w": (1, 3, True), "d": (2, 1, True), "s": (1, 2, False), "b": (1, 2, False)}
    rough = {r["name"]: r["missing"] for r in profile.profile_columns(df, approx=True).collect()}
    assert rough == {k: v[0] for k, v in got.items()}


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError, match="nested"):
        profile.profile_columns(spark.sql("select array(1) as a"))


def test_require_rows(spark):
    with pytest.raises(ValueError):
        profile.require_rows(spark.createDataFrame([], "a int"))


def test_outliers_need_eight_values_and_a_spread(spark):
    short = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 3, 4, 5, 6, 100)], "a double, c double")
    assert profile.iqr_outliers(short).count() == 0
    long = short.unionAll(short)
    rows = profile.iqr_outliers(long).collect()
    assert [(r["column"], r["outliers"]) for r in rows] == [("a", 2)]
    assert profile.iqr_outliers(long, approx=True).collect()[0]["outliers"] == 2


def test_fixed_order_of_steps(spark):
    rows = [("1,000",), (" 3 ",), ("x",), (None,)] * 2 + [("5",)]
    df = spark.createDataFrame(rows, "v string")
    out = cleaning.apply_cleaning(df, ["fill_missing::v", "convert_numeric::v", "drop_duplicates"])
    # distinct texts first, then numbers 1000, 3 and 5 with median 5 in the two gaps
    assert sorted(r[0] for r in out.data.collect()) == [3.0, 5.0, 5.0, 5.0, 1000.0]
    assert [r["operation"] for r in out.log().collect()] == ["drop_duplicates", "convert_numeric", "fill_missing"]
    summary = {r["side"]: (r["rows"], r["missing"]) for r in out.summary().collect()}
    assert summary == {"original": (9, 2), "cleaned": (5, 0)}


def test_fill_keeps_types(spark):
    day = datetime.date(2024, 1, 2)
    df = spark.createDataFrame([(1, True, day, "x"), (2, True, day, None), (None, None, None, None)], "i int, b boolean, d date, s string")
    out = cleaning.fill_missing(df, cleaning.fill_values(df, df.columns))
    assert out.schema["i"].dataType.simpleString() == "double"
    assert out.collect()[2] == (1.5, True, day, "x")
    empty = spark.createDataFrame([(None, None)], "s string, d double")
    assert cleaning.fill_missing(empty, cleaning.fill_values(empty, ["s", "d"])).first() == ("未知", None)


def test_cap_and_infinity(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)], "v double")
    assert [r[0] for r in cleaning.cap_iqr(df).collect()] == [1.0, 2.0, 3.0, 4.0, 7.0, None]
    flat = spark.createDataFrame([(v,) for v in (5.0, 5.0, 5.0, 5.0, 9.0)], "v double")
    assert {r[0] for r in cleaning.cap_iqr(flat).collect()} == {5.0}
    odd = spark.createDataFrame([(inf, 1), (-inf, 2), (float("nan"), 3), (1.5, 4)], "v double, k int")
    assert [r[0] for r in cleaning.inf_to_null(odd).orderBy("k").collect()] == [None, None, None, 1.5]


def test_unknown_suggestions_are_refused(trips):
    for bad in ("fill_missing::nope", "explode", "fill_missing", "drop_duplicates::mode"):
        with pytest.raises(ValueError):
            cleaning.apply_cleaning(trips, [bad])
    assert cleaning.resolve_columns(trips, ["Fare (EUR)"], True) == ["fare_eur"]
