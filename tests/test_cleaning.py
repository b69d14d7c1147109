from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from nimbusops.config import Params
from nimbusops.functions import times, values
from nimbusops.operators import cleaning

PARAMS = Params()


def column(spark, rows, expression, schema="v string"):
    frame = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in frame.select(expression).collect()]


def test_hhmm(spark):
    assert column(spark, ["605", "0605", "2400", "5", None], times.hhmm_minutes(F.col("v"))) == [365, 365, 1440, 5, None]


def test_sentinels(spark):
    texts = ["M", "T", "0.12", None]
    assert column(spark, texts, values.sentinel_number(F.col("v"), trace=0)) == [None, 0.0, 0.12, None]
    assert column(spark, texts, values.sentinel_number(F.col("v"))) == [None, None, 0.12, None]


def test_unexpected_text_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["abc"], values.sentinel_number(F.col("v")))


def test_ratio_of_empty_whole(spark):
    frame = spark.createDataFrame([(1, 0), (1, 3)], "a int, b int")
    assert [r[0] for r in frame.select(values.rate(F.col("a"), F.col("b"))).collect()] == [None, 0.3333]


def test_local_time_over_daylight_saving(spark):
    utc = [datetime(2021, 3, 14, 7, 59), datetime(2021, 3, 14, 8, 0), datetime(2021, 11, 7, 6, 30), datetime(2021, 11, 7, 7, 30)]
    local = [datetime(2021, 3, 14, 1, 59), datetime(2021, 3, 14, 3, 0), datetime(2021, 11, 7, 1, 30), datetime(2021, 11, 7, 1, 30)]
    assert column(spark, utc, times.utc_to_local("America/Chicago", F.col("v")), "v timestamp_ntz") == local
    by_row = times.utc_to_local(F.lit("America/Chicago"), F.col("v"))
    assert column(spark, utc, by_row, "v timestamp_ntz") == local


def timed(make, *rows):
    flights = cleaning.time_flights(cleaning.clean_flights(make.flights(*rows)), PARAMS)
    return flights.orderBy("flight_number").collect()


def test_arrival_rolls_over_midnight(make):
    late, west, outside, midnight = timed(
        make,
        {"CRSDepTime": "2300", "CRSArrTime": "0130"},
        {"Origin": "LAX", "CRSDepTime": "1000", "CRSArrTime": "900"},
        {"Dest": "JFK"},
        {"CRSDepTime": "2400"},
    )
    assert late.scheduled_arr_ts == datetime(2021, 2, 11, 1, 30)
    assert west.scheduled_arr_ts == datetime(2021, 2, 10, 9, 0) and west.is_arrival and not west.is_departure
    assert outside.scheduled_arr_ts is None and not outside.is_arrival
    assert midnight.scheduled_dep_ts == datetime(2021, 2, 11)


def test_arrival_exactly_six_hours_earlier_stays(make):
    same, moved = timed(make, {"CRSDepTime": "1800", "CRSArrTime": "1200"}, {"CRSDepTime": "1801", "CRSArrTime": "1200"})
    assert same.scheduled_arr_ts == datetime(2021, 2, 10, 12)
    assert moved.scheduled_arr_ts == datetime(2021, 2, 11, 12)


def test_outcome_flags(make):
    cancelled, unknown, late, rounded = timed(
        make,
        {"Cancelled": 1.0, "DepDelay": 40.0, "CancellationCode": "B"},
        {"DepDelay": None},
        {"DepDelay": 15.0},
        {"DepDelay": 1.5},
    )
    assert cancelled.is_dep_delayed_15 is False and cancelled.actual_dep_ts is None
    assert cancelled.cancellation_reason == "weather"
    assert unknown.is_dep_delayed_15 is None and unknown.actual_dep_ts is None
    assert late.is_dep_delayed_15 is True and late.actual_dep_ts == datetime(2021, 2, 10, 10, 15)
    assert rounded.actual_dep_ts == datetime(2021, 2, 10, 10, 2)


def test_observation_units(make):
    row = cleaning.clean_observations(
        make.reports({"tmpf": "32", "dwpf": "T", "sknt": "10", "vsby": "1", "skyl1": "1000", "p01i": "T",
                      "ice_accretion_1hr": "0.1", "wxcodes": "M", "skyc1": "OVC"}), "America/Chicago").collect()[0]
    assert (row.temp_c, row.dewpoint_c, row.wind_speed_kmh, row.visibility_km) == (0.0, None, 18.5, 1.61)
    assert (row.cloud_base_lowest_m, row.precip_mm, row.is_precip_trace) == (305.0, 0.0, True)
    assert (row.ice_accretion_1h_mm, row.weather_codes, row.sky_cover_lowest) == (2.54, None, "OVC")
    assert row.valid_local == datetime(2021, 2, 10, 4, 53)


def test_key_skips_missing_parts(spark):
    frame = spark.createDataFrame([(date(2021, 1, 2), None, 7)], "d date, s string, n int")
    expected = frame.select(F.md5(F.lit("2021-01-02|7"))).collect()[0][0]
    assert frame.select(values.surrogate_key("d", "s", "n")).collect()[0][0] == expected


def test_rounding_is_half_away_from_zero(spark):
    numbers = [1.005, 2.675, 0.25, -0.25, -0.35, 12.34, None]
    assert column(spark, numbers, values.rounded(F.col("v"), 1), "v double") == [1.0, 2.7, 0.3, -0.3, -0.4, 12.3, None]
    assert column(spark, [1.005], values.rounded(F.col("v"), 2), "v double") == [1.0]
    assert column(spark, [2.5, -2.5, 2.4], values.rounded(F.col("v"), 0), "v double") == [3.0, -3.0, 2.0]
