"""C1-C12: duplicates, markers, imputation, dates, delivery time."""

import datetime

from tabloom.operators import clean, dates
from tabloom.plans.service import preprocess
from tabloom.types import without_rid


def T(*x):
    return datetime.datetime(*x)


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a long, b string")
    out, r = clean.remove_duplicates(df)
    assert out.count() == 2 and r["details"] == {"rows_before": 3, "rows_after": 2, "duplicates_removed": 1}
    assert clean.distinct_rows(df, keep_first=True).count() == 2


def test_markers_t8(spark):
    values = ["", " ", "NA", " n/a ", "NULL", "none", "Unknown", "?", "nan", "ok", "\tna\n", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    out, r = clean.normalize_markers(df)
    assert [x["c"] for x in out.collect() if x["c"] is not None] == ["nan", "ok"]
    assert r["details"]["values_normalized"] == 9


def test_t9_markers_keep_the_type(spark):
    out = clean.without_markers(spark.createDataFrame([("1",), ("?",)], "n string"))
    assert out.dtypes == [("n", "string")]


def test_imputation_and_mode_tie_t13(spark):
    df = spark.createDataFrame([(1.0, "b", None), (None, "a", None), (3.0, None, None)], "n double, c string, e string")
    out, r = clean.handle_missing(df)
    assert [x["n"] for x in out.collect()] == [1.0, 2.0, 3.0] and out.collect()[2]["c"] == "a"
    assert r["details"] == {"missing_before": 5, "missing_after": 3, "missing_values_filled": 2}


def test_no_dates(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, remarks string")
    assert dates.convert_dates(df)[1]["status"] == "Skipped"


def test_iso_and_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-01", "x"), ("2020-02-03", "y")], "`Order Date` string, `Bad Date` string")
    out, r = dates.convert_dates(df)
    assert r["details"]["date_columns_converted"] == ["Order Date"] and r["details"]["date_columns_nat_count"] == 0
    assert out.collect()[1]["Order Date"] == T(2020, 2, 3)


def test_t11_first_value_sets_the_order(spark):
    a = dates.convert_dates(spark.createDataFrame([("11/8/2016",), ("13/8/2016",)], "d string").coalesce(1))
    assert [x["d"] for x in a[0].collect()] == [T(2016, 11, 8), None] and a[1]["details"]["date_columns_nat_count"] == 1
    b = dates.convert_dates(spark.createDataFrame([("13/8/2016",), ("11/8/2016",)], "d string").coalesce(1))[0]
    assert [x["d"] for x in b.collect()] == [T(2016, 8, 13), T(2016, 8, 11)]


def test_negatives_are_no_dates(spark):
    for v in ("10", "10015", "12:30", "A1", "May", "Sat", "CA-2016-152156"):
        df = spark.createDataFrame([(v,)], "d string")
        assert dates.date_columns(df) == [], v
    assert dates.date_columns(spark.createDataFrame([("2016",)], "d string")) == ["d"]


def test_parts_and_names(spark):
    df = spark.createDataFrame([(T(2020, 1, 5), T(2020, 1, 8))], "`Order Date` timestamp_ntz, `Ship Date` timestamp_ntz")
    out, r = dates.extract_date_parts(df)
    assert out.columns[2:] == [f"{b} {p}" for b in ("Order", "Ship") for p in ("Year", "Month", "Day", "Weekday")]
    assert list(out.first())[2:6] == [2020, 1, 5, 6]
    assert dates.base_name("date") == "date" and dates.base_name("o_orderdate") == "o_orderdate"


def test_delivery_t12(spark):
    rows = [(T(2020, 1, 1), T(2020, 1, 4)), (T(2020, 1, 2), T(2020, 1, 1)), (T(2020, 1, 1, 23), T(2020, 1, 2, 0, 30)), (T(2020, 1, 2), T(2020, 1, 1, 1, 30))]
    df = spark.createDataFrame(rows, "`Order Date` timestamp_ntz, `Ship Date` timestamp_ntz")
    out, r = dates.delivery_time(df)
    assert [x["Delivery Time (Days)"] for x in out.collect()] == [3, -1, 0, -1] and r["details"]["negative_delivery_days"] == 2
    assert dates.delivery_time(df.drop("Ship Date"))[1]["status"] == "Skipped"


def test_whole_chain(spark):
    rows = [("2020-01-01", "2020-01-03", "a", 1.0), ("2020-01-02", "2020-01-04", None, None), ("2020-01-03", "2020-01-06", "a", 3.0)]
    out, r = preprocess(spark.createDataFrame(rows, "`Order Date` string, `Ship Date` string, category string, numeric double"))
    assert r["duplicates"]["details"]["duplicates_removed"] == 0 and r["missing_values"]["details"]["missing_values_filled"] == 2
    assert without_rid(out).count() == 3 and "Delivery Time (Days)" in r["generated_columns"] and "Order Year" in r["generated_columns"]  # T5
