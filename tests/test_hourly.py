from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from nimbusops.config import Event, Params, events_frame
from nimbusops.operators import cleaning, hourly

UTC = Params(local_timezone="UTC")
FLAGS = ["has_freezing_rain", "has_ice_pellets", "has_snow", "has_rain", "has_fog", "has_thunder"]


def observed(make, *rows):
    return cleaning.clean_observations(make.reports(*rows), "UTC")


def at(hour, minute=0, day=10):
    return datetime(2021, 2, day, hour, minute)


@pytest.mark.parametrize("codes, expected", [
    ("-FZRA BR", {"has_freezing_rain"}), ("BLSN", set()), ("VCTS", set()), ("-DRSN", set()),
    ("TSRA", {"has_rain", "has_thunder"}), ("FZDZ RA", {"has_freezing_rain", "has_rain"}),
    ("SG FZFG", {"has_snow", "has_fog"}), ("PL", {"has_ice_pellets"}), ("M", set()),
])
def test_codes(make, codes, expected):
    reports = observed(make, {"wxcodes": codes})
    by_report = hourly.parse_weather_codes(reports).select(*FLAGS).collect()[0].asDict()
    assert {f for f, v in by_report.items() if v} == expected
    by_hour = hourly.hourly_observations(reports, UTC).select(*FLAGS).collect()[0].asDict()
    assert by_hour == by_report


def test_hour_shift(make):
    times = [at(10, 53), at(11, 52), at(11, 53)]
    hours = hourly.assign_hour(observed(make, *[{"valid_utc": t} for t in times]), 7).orderBy("valid_utc")
    assert [r.weather_hour for r in hours.collect()] == [at(11), at(11), at(12)]


def test_hour_values(make):
    row = hourly.hourly_observations(observed(
        make,
        {"valid_utc": at(10, 53), "tmpf": "41", "p01i": "0.2", "wxcodes": "SN"},
        {"valid_utc": at(11, 10), "report_type": "special", "tmpf": "14", "p01i": "0.3", "wxcodes": "-RA"},
        {"valid_utc": at(11, 40), "tmpf": "M", "p01i": "0.1", "wxcodes": "-RA"},
        {"valid_utc": at(11, 50), "report_type": "special", "p01i": "0.5", "wxcodes": "VCTS"},
    ), UTC).collect()[0]
    assert (row.n_reports, row.n_special_reports) == (4, 2)
    assert row.temp_c == 5.0, "the newest routine value is unknown, the one before counts"
    assert row.temp_min_c == -10.0
    assert row.precip_mm == 2.54, "special reports carry running totals"
    assert row.weather_codes_hour == "-RA | SN" and not row.has_thunder


def test_grid_is_dense_and_uses_unshifted_months(make):
    reports = observed(make, {"valid_utc": datetime(2021, 1, 31, 23, 53)})
    hours = hourly.hourly_observations(reports, UTC)
    assert hours.collect()[0].weather_hour == datetime(2021, 2, 1)
    grid = hourly.hour_grid(hourly.report_months(hours, ["airport_code"]), ["airport_code"])
    bounds = grid.agg(F.count("*"), F.min("weather_hour"), F.max("weather_hour")).collect()[0]
    assert tuple(bounds) == (744, datetime(2021, 1, 1), datetime(2021, 1, 31, 23))
    assert hourly.fill_grid(grid, hours).where("has_report").count() == 0


def weather_of(make, *rows):
    reports = observed(make, *rows)
    hours = hourly.hourly_observations(reports, UTC)
    return hourly.fill_grid(hourly.hour_grid(hourly.report_months(hours, ["airport_code"]), ["airport_code"]), hours)


def test_extended_grid_has_the_midnight_after_the_last_month(make):
    times = [datetime(2021, 1, 5), datetime(2021, 2, 5), datetime(2021, 5, 5)]
    months = hourly.report_months(hourly.hourly_observations(observed(make, *[{"valid_utc": t} for t in times]), UTC), ["airport_code"])
    grid = hourly.hour_grid(months, ["airport_code"], extend=True)
    hours = [r.weather_hour for r in grid.orderBy("weather_hour").collect()]
    assert len(hours) == len(set(hours)) == (31 + 28 + 31) * 24 + 2
    assert datetime(2021, 3, 1) in hours and datetime(2021, 6, 1) in hours and datetime(2021, 3, 1, 1) not in hours


def test_empty_and_labelled_hours(make):
    filled = weather_of(make, {"valid_utc": at(5, 53), "wxcodes": "PL SN RA"}, {"valid_utc": at(6, 53)})
    rows = {r.weather_hour: r for r in filled.collect()}
    assert len(rows) == 28 * 24
    assert rows[at(6)].weather_group == "ice_pellets" and rows[at(6)].has_winter_precip
    assert rows[at(7)].weather_group == "none" and rows[at(7)].has_winter_precip is False
    empty = rows[at(8)]
    assert (empty.has_report, empty.n_reports, empty.has_snow, empty.has_winter_precip, empty.weather_group) == \
        (False, 0, None, None, None)


EVENT = Event("e", "Event", "E", date(2021, 2, 1), date(2021, 2, 20), date(2021, 2, 9), date(2021, 2, 10))


def test_airport_hourly_periods_and_rates(spark, make):
    flights = cleaning.time_flights(cleaning.clean_flights(make.flights(
        {"CRSDepTime": "2330", "Cancelled": 1.0, "CancellationCode": "A"}, {"CRSDepTime": "2310", "DepDelay": 20.0},
        {"CRSDepTime": "2320", "DepDelay": None, "TaxiOut": 20.0},
        {"CRSDepTime": "0010", "Cancelled": 1.0, "CancellationCode": "B", "DepDelay": 30.0})), UTC)
    hours = hourly.airport_hourly(weather_of(make, {"valid_utc": at(5)}), hourly.hourly_departures(flights),
                                  events_frame(spark, [EVENT]))
    rows = {r.weather_hour: r for r in hours.collect()}
    busy = rows[at(23)]
    assert (busy.scheduled_departures, busy.cancelled, busy.cancelled_carrier, busy.delayed_15) == (3, 1, 1, 1)
    assert (busy.cancellation_rate, busy.delay_15_rate, busy.avg_dep_delay_min, busy.avg_taxi_out_min) == (0.3333, 0.5, 20.0, 15.0)
    assert rows[at(0)].delay_15_rate is None and rows[at(0)].cancellation_rate == 1.0
    assert rows[at(1)].scheduled_departures == 0 and rows[at(1)].cancellation_rate is None
    assert [rows[h].storm_period for h in (at(23, day=8), at(0, day=9), at(23), at(0, day=11))] == \
        ["before", "storm", "storm", "after"]
    outside = rows[at(3, day=25)]
    assert (outside.event_id, outside.storm_period, outside.hours_from_storm_start) == (None, "after", None)
    assert rows[at(1, day=9)].hours_from_storm_start == 1 and rows[at(22, day=8)].hours_from_storm_start == -2


def test_flights_without_hour_stay(spark, make):
    flights = cleaning.time_flights(cleaning.clean_flights(make.flights(
        {"FlightDate": date(2021, 2, 28), "CRSDepTime": "2400"}, {"CRSDepTime": "0559"})), UTC)
    joined = hourly.flights_weather(
        hourly.departures_with_event(flights, events_frame(spark, [EVENT])),
        weather_of(make, {"valid_utc": at(5), "wxcodes": "SN"})).orderBy("flight_number").collect()
    assert [(r.event_id, r.weather_group) for r in joined] == [(None, None), ("e", "snow")]
