"""Unit tables for the scalar functions, with every quirk of the source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from farebox.functions import columns as C
from farebox.functions import filters as FL


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("1", True), ("0", False), ("1.0", False), (" 1", False), ("", None), ("NULL", None),
    (" null ", None), (None, None), ("\t", None), ("yes", False)])
def test_parse_flag(spark, text, expected):
    assert one(spark, C.parse_flag, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("12.5", 12.5), (" 7 ", 7.0), ("1,234.5", 1234.5), ("1e3", 1000.0), ("abc", None),
    ("1.0d", None), ("2f", None), ("", None), ("null", None), ("-3", -3.0), ("1.5,0", None)])
def test_parse_number(spark, text, expected):
    assert one(spark, C.parse_number, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("2024-03-23", dt.date(2024, 3, 23)), ("03/23/2024", dt.date(2024, 3, 23)),
    ("3/5/2024", dt.date(2024, 3, 5)), ("2024-13-01", None), ("null", None), ("", None)])
def test_parse_date(spark, text, expected):
    assert one(spark, C.parse_date, text) == expected


def test_combine_timestamp(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), "12:29:38"), (None, "08:00:00"),
                                (dt.date(2024, 1, 2), None)], "d date, t string")
    got = [r[0] for r in df.select(C.combine_timestamp("d", "t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 12, 29, 38), None, None]


@pytest.mark.parametrize("bad", ["", "25:00:00", "noon"])
def test_combine_timestamp_bad_time_fails_the_job(spark, bad):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), bad)], "d date, t string")
    with pytest.raises(Exception):
        df.select(C.combine_timestamp("d", "t")).collect()


def test_strip_and_trim(spark):
    assert one(spark, C.strip_quotes, '  """CNR1""" ') == "CNR1"
    assert one(spark, C.strip_quotes, ' "CNR1" ') == "CNR1"
    assert one(spark, C.trim_spaces, "\t a ") == "\t a"


def test_unify_reason_uses_untrimmed_status(spark):
    df = spark.createDataFrame([("  Cancelled by Customer", "x", "y", "z"),
                                ("Cancelled by Driver", "x", "y", "z"),
                                ("Incomplete", "x", "y", None), ("Completed", "x", "y", "z")],
                               "s string, a string, b string, c string")
    got = [r[0] for r in df.select(C.unify_reason("s", "a", "b", "c")).collect()]
    assert got == ["Not Cancelled", "y", None, "Not Cancelled"]


@pytest.mark.parametrize("text,expected", [
    (None, "Not Specified"), (" NULL ", "Not Specified"), ("", ""), (" UPI ", "UPI")])
def test_default_payment(spark, text, expected):
    assert one(spark, C.default_payment, text) == expected


def test_safe_ratio_and_round(spark):
    df = spark.createDataFrame([(10.0, 4.0), (10.0, 0.0), (1.005, 1.0), (2.675, 1.0)], "v double, d double")
    got = [tuple(r) for r in df.select(C.safe_ratio("v", "d"), C.round_half_up(F.col("v"), 2)).collect()]
    assert got == [(2.5, 10.0), (0.0, 10.0), (1.005, 1.01), (2.675, 2.68)]


def test_hash_uuid_and_key(spark):
    import hashlib
    h = hashlib.md5("CNR000000001".encode()).hexdigest()
    want = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    assert one(spark, C.hash_uuid, "CNR000000001") == want
    key = one(spark, lambda c: C.generate_key(c), "CNR000000001")
    assert key == "BOK-" + h[:10].upper()
    rnd = spark.range(1).select(C.generate_key().alias("k")).first()["k"]
    assert rnd.startswith("BOK-") and len(rnd) == 14


@pytest.mark.parametrize("text,expected_ms", [
    ("2024-01-01T00:00:00", 1704067200000), ("2024-01-01T00:00:00Z", 1704067200000),
    ("2024-01-01T03:30:00+03:30", 1704067200000), ("2024-01-01T03:30:00+0330", 1704067200000),
    ("2024-01-01T00:00:00z", 1704067200000)])
def test_as_utc(spark, text, expected_ms):
    assert one(spark, lambda c: F.unix_millis(C.as_utc(c)), text) == expected_ms


def test_format_number_text(spark):
    assert one(spark, lambda c: C.format_number_text(c, 2), 1234.5, "v double") == "۱۲۳۴,۵۰"
    assert one(spark, lambda c: C.format_number_text(c, 2), None, "v double") == "۰"


@pytest.mark.parametrize("ms,expected", [
    (0, "۰,۰۰ م.ث"), (999, "۹۹۹,۰۰ م.ث"), (3125, "۳,۱۳ ث"), (61500, "۱د ۱,۵۰ث"), (-5, "۰,۰۰ م.ث")])
def test_duration_text(spark, ms, expected):
    start = dt.datetime(2024, 1, 1)
    end = start + dt.timedelta(milliseconds=ms)
    df = spark.createDataFrame([(start, end)], "s timestamp_ntz, e timestamp_ntz")
    assert df.select(C.duration_text("s", "e")).first()[0] == expected


def test_duration_open_run_uses_now(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), None)], "s timestamp_ntz, e timestamp_ntz")
    now = F.lit(dt.datetime(2024, 1, 1, 0, 0, 2)).cast("timestamp_ntz")
    assert df.select(C.duration_text("s", "e", now)).first()[0] == "۲,۰۰ ث"


def test_can_resume(spark):
    df = spark.createDataFrame([("Failed", "Silver"), ("Failed", "Bronze"), ("Success", "Gold"),
                                ("Failed", "Gold")], "st string, step string")
    assert [r[0] for r in df.select(C.can_resume("st", "step")).collect()] == [True, False, False, True]


def test_filters(spark):
    df = spark.createDataFrame([("Bike", "Completed", "c1", "x"), ("", "Completed", "c2", "Not Cancelled"),
                                ("Auto", "Completed", "c3", None)],
                               "vehicle_type string, booking_status string, customer_id string, r string")
    assert FL.ride_filter(df, vehicle="").count() == 1          # empty text matches nothing else
    assert FL.ride_filter(df, vehicle=None).count() == 3
    assert df.where(FL.exclude_value("r")).count() == 1          # NULL reasons drop too
    assert FL.dashboard_filter(df, vehicle="").count() == 3      # empty vehicle = no filter
    nan = spark.createDataFrame([(float("nan"),), (5.0,), (None,), (5.1,)], "r double")
    assert [r[0] for r in nan.select(FL.rating_ok("r")).collect()] == [False, True, True, False]


def test_sums_and_averages_keep_small_and_huge_values(spark):
    from farebox.operators import corpus as K
    from farebox.operators import profile as P
    small = spark.createDataFrame([(0.0003,), (0.0004,), (None,)], "v double")
    assert abs(P.numeric_describe(small, ["v"]).first()["mean"] - 0.00035) < 1e-12
    money = "booking_value double"
    cents = spark.createDataFrame([(1.2345,), (2.3456,)], money)
    assert abs(K.total_revenue(cents).first()[0] - 3.5801) < 1e-12
    huge = spark.range(2000).select(F.lit(8.9e12).alias("booking_value"))
    assert K.total_revenue(huge).first()[0] == 8.9e12 * 2000
    assert K.total_revenue(spark.createDataFrame([], money)).first()[0] is None


def test_clock_times_with_am_and_pm(spark):
    times = ["10:00 PM", "12:05 am", "12:30:15pm", " 1:02:03.5 AM ", "23:59"]
    df = spark.createDataFrame([("2024-03-01", t) for t in times], "d string, t string")
    got = [str(r[0]) for r in df.select(C.combine_timestamp(F.col("d").cast("date"), "t")).collect()]
    assert got == ["2024-03-01 22:00:00", "2024-03-01 00:05:00", "2024-03-01 12:30:15",
                   "2024-03-01 01:02:03.500000", "2024-03-01 23:59:00"]
    bad = spark.createDataFrame([("2024-03-01", "13:00 PM")], "d string, t string")
    with pytest.raises(Exception, match="invalid input syntax"):
        bad.select(C.combine_timestamp(F.col("d").cast("date"), "t")).collect()


def test_number_words_are_not_numbers(spark):
    df = spark.createDataFrame([("inf",), ("-Infinity",), ("NaN",), ("1e3",)], "v string")
    assert [r[0] for r in df.select(C.parse_number("v")).collect()] == [None, None, None, 1000.0]


def test_traffic_stats_ties_and_mean(spark):
    from farebox.operators import dashboard as D
    hourly = spark.createDataFrame([(3, 10), (7, 10), (1, 2), (9, 2), (5, 5)], "hour int, ride_count long")
    r = D.traffic_stats(hourly).first()
    assert (r["peak_count"], r["peak_hour"]) == (10, 3)          # earliest hour on a tie
    assert (r["min_count"], r["min_hour"]) == (2, 1)
    assert r["mean_count"] == 6                                   # 29 / 5 = 5.8 -> 6
    half = spark.createDataFrame([(0, 1), (1, 2)], "hour int, ride_count long")
    assert D.traffic_stats(half).first()["mean_count"] == 2       # 1.5 rounds half up


def test_page_count_and_shares(spark):
    from farebox.operators import dashboard as D
    from farebox.operators import lookup as L
    df = spark.createDataFrame([(41,), (40,), (0,)], "n long")
    assert [r[0] for r in df.select(L.page_count(F.col("n"), 20)).collect()] == [3, 2, 0]
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "reason string, count long")
    got = {r["reason"]: (r["pct"], r["pct_of_max"]) for r in
           D.share_of_max(D.share_of_total(counts)).collect()}
    assert got == {"a": (33.3, 50.0), "b": (66.7, 100.0)}


def test_strip_quotes_edges(spark):
    assert one(spark, C.strip_quotes, '""') == ""
    assert one(spark, C.strip_quotes, ' "a"b" ') == 'a"b'
    assert one(spark, C.strip_quotes, None) is None


def test_format_number_text_as_printed(spark):
    assert one(spark, lambda c: C.format_number_text(c), 1234.0, "v double") == "۱۲۳۴"
    assert one(spark, lambda c: C.format_number_text(c), 12.5, "v double") == "۱۲,۵"
    assert one(spark, lambda c: C.format_number_text(c), 7, "v long") == "۷"
