from datetime import date, datetime

import pytest

from nimbusops.config import Event, Params, airline_groups_frame, events_frame
from nimbusops.operators import hourly
from nimbusops.plans import marts, reports

PARAMS = Params()
EVENT = Event("e", "Event", "E", date(2024, 2, 1), date(2024, 2, 29), date(2024, 2, 8), date(2024, 2, 10))
ONSET = datetime(2024, 2, 8, 5)

DEPARTURES = ("event_id string, airport_code string, day date, departures long, cancelled long, cancelled_weather long, "
              "cancelled_carrier long, cancelled_nas long, delayed_15 long")
STORMS = "event_id string, airport_code string, storm_first_day date, storm_last_day date"
WEATHER = ("airport_code string, day date, winter_hours long, thunder_hours long, rain_hours long, min_temp_c double, "
           "max_gust_kmh double, min_visibility_km double")
ARRIVALS = "airport_code string, day date, arrivals long, diverted_arrivals long"
SUMMARY = ("event_id string, airport_code string, storm_onset timestamp_ntz, precip_end timestamp_ntz, "
           "sustained_onset timestamp_ntz, recovery_h long")


def summary(spark, sustained=None, recovery=None, onset=ONSET, end=datetime(2024, 2, 8, 9)):
    return spark.createDataFrame([("e", "DFW", onset, end, sustained, recovery)], SUMMARY)


def inputs(spark, departures, weather=()):
    return (
        spark.createDataFrame([("e", "DFW", date(2024, 2, d), *rest) for d, *rest in departures], DEPARTURES),
        spark.createDataFrame([("e", "DFW", date(2024, 2, 7), date(2024, 2, 11))], STORMS),
        spark.createDataFrame([("DFW", date(2024, 2, d), *rest, None, None, None) for d, *rest in weather], WEATHER),
        spark.createDataFrame([("DFW", date(2024, 2, 14), 30, 2), ("DFW", date(2024, 2, 15), 30, 5)], ARRIVALS),
    )


def test_unusual_days_and_reasons(spark):
    frames = inputs(spark, [
        (7, 100, 50, 50, 0, 0, 0),     # storm period
        (14, 20, 6, 3, 3, 0, 1),       # tie: weather before carrier
        (15, 100, 5, 0, 0, 5, 0),      # exactly 5 %
        (16, 19, 19, 0, 19, 0, 0),     # too few departures
        (17, 1000, 49, 0, 20, 29, 0),  # 4.9 %
        (18, 0, 0, 0, 0, 0, 0),        # no departures
        (29, 100, 40, 0, 20, 20, 0),   # leap day, carrier before nas
    ], [(14, 2, 1, 0), (15, 0, 1, 0)])
    daily = {r.day.day: r for r in marts.airport_daily(*frames, events_frame(spark, [EVENT]), PARAMS).collect()}
    assert [d for d, r in sorted(daily.items()) if r.is_unusual] == [14, 15, 29]
    assert [daily[d].unusual_reason for d in (14, 15, 29)] == ["local snow or ice", "thunderstorms", "weather elsewhere"]
    assert [daily[d].main_cancel_reason for d in (14, 15, 17, 29)] == ["weather", "nas", "nas", "carrier"]
    assert daily[18].main_cancel_reason is None and daily[18].cancel_rate is None and daily[18].is_unusual is False
    assert daily[7].is_storm_period and daily[29].aligned_day == date(2020, 2, 29)
    assert (daily[14].diverted_arrivals, daily[16].arrivals, daily[16].normal_diverted_arrivals) == (2, 0, 3.5)

    days = {r.flight_day.day: r for r in marts.unusual_days(*frames, PARAMS).collect()}
    assert [days[d].unusual_explanation for d in (7, 14, 15, 29)] == \
        [None, "local snow or ice", "local thunderstorms", "weather elsewhere in the network"]
    assert days[15].airport_day_id == "DFW_2024-02-15"
    # normal days: outside the storm, no winter hours, enough departures -> 15, 17 and 29
    assert days[14].normal_cancel_rate == 0.05


def test_rounded_and_exact_rates_differ(spark):
    frames = inputs(spark, [(14, 100000, 4996, 4996, 0, 0, 0)])
    assert marts.airport_daily(*frames, events_frame(spark, [EVENT]), PARAMS).collect()[0].is_unusual is True
    assert marts.unusual_days(*frames, PARAMS).collect()[0].is_unusual is False


@pytest.mark.parametrize("recovery, last_day", [(None, date(2024, 2, 11)), (20, date(2024, 2, 9))])
def test_storm_days(spark, recovery, last_day):
    row = marts.storm_days(summary(spark, recovery=recovery), PARAMS).collect()[0]
    assert (row.storm_first_day, row.storm_last_day) == (date(2024, 2, 7), last_day)


def hours(spark):
    weather = spark.sql("""
        SELECT 'e' AS event_id, 'DFW' AS airport_code, h AS weather_hour, string(h) AS airport_hour_id, 10L AS scheduled_departures,
               1L AS cancelled, 0L AS delayed_15, 0.1D AS cancellation_rate, false AS has_winter_precip, 'none' AS weather_group,
               0D AS temp_c
        FROM (SELECT explode(sequence(timestamp_ntz'2024-02-01', timestamp_ntz'2024-02-29 23:00', interval 1 hour)) AS h)""")
    return weather


def test_timeline_phases(spark):
    def phases(**kwargs):
        timeline = marts.storm_timeline(hours(spark), summary(spark, **kwargs), events_frame(spark, [EVENT]), PARAMS)
        return {r.hours_from_onset: r for r in timeline.collect()}

    found = phases(recovery=3)
    assert (len(found), min(found), max(found)) == (192, -48, 143)
    assert [found[i].storm_phase for i in (-1, 0, 4, 5, 6, 7)] == \
        ["before", "precipitation", "precipitation", "recovery", "recovery", "normal"]
    assert [found[i].hours_from_onset_3h for i in (-5, -3, -1, 0, 4)] == [-6, -3, -3, 0, 3]
    assert phases(recovery=None)[143].storm_phase == "recovery"
    moved = phases(recovery=3, sustained=datetime(2024, 2, 8, 7))
    assert moved[0].weather_hour == datetime(2024, 2, 8, 7) and moved[-1].storm_phase == "before"
    assert marts.storm_timeline(
        hours(spark), summary(spark, onset=None, end=None), events_frame(spark, [EVENT]), PARAMS).count() == 0


def test_binned_rates_blank_sparse_bins(spark):
    timeline = spark.createDataFrame(
        [("e", "DFW", 0, 1, 1), ("e", "DFW", 0, 1, 0), ("e", "DFW", 3, 3, 1)],
        "event_id string, airport_code string, hours_from_onset_3h int, scheduled_departures long, cancelled long")
    rows = {r.bin_start: r for r in reports.binned_rates(timeline, PARAMS).collect()}
    assert rows[0].rate_pct is None and rows[0].bin_mid == 1.5
    assert rows[3].rate_pct == pytest.approx(100 / 3)


def flight_rows(airline, n, cancelled, winter, delay, hour):
    return [("e", "DFW", airline, i < cancelled, "B", winter, "snow" if winter else "none", delay + i % 3, 10.0 + winter, hour)
            for i in range(n)]


FLIGHTS = ("event_id string, origin_airport string, airline_code string, is_cancelled boolean, cancellation_code string, "
           "has_winter_precip boolean, weather_group string, dep_delay_min double, taxi_out_min double, "
           "scheduled_dep_hour timestamp_ntz")


def test_low_samples_are_suppressed(spark):
    before, during, other_day = datetime(2024, 2, 7, 6), datetime(2024, 2, 8, 6), datetime(2024, 2, 20)
    rows = (
        flight_rows("AA", 29, 0, False, 1.0, before) + flight_rows("MQ", 1, 1, False, 1.0, before)   # 30 as a group
        + flight_rows("DL", 29, 5, False, 1.0, before)
        + flight_rows("AA", 50, 30, True, 31.0, during)   # 20 operated
        + flight_rows("DL", 50, 31, True, 31.0, during)   # 19 operated
        + flight_rows("ZZ", 3, 0, False, 1.0, other_day)  # only operated, unknown airline
    )
    flights = marts.with_airline_group(spark.createDataFrame(rows, FLIGHTS), airline_groups_frame(spark))
    histogram = marts.condition_histogram(flights, marts.GROUP)
    onset = marts.onset_flights(flights, summary(spark), PARAMS)
    got = {r.airline_group: r for r in marts.airline_storm(
        marts.airline_windows(onset), marts.winter_normal_medians(histogram), PARAMS).collect()}
    assert set(got) == {"American", "Delta", "Other"}
    american, delta, other = got["American"], got["Delta"], got["Other"]
    assert american.airline_storm_id == "e_DFW_American"
    assert american.cancel_rate_before == pytest.approx(1 / 30) and delta.cancel_rate_before is None
    assert american.cancel_rate_during == 0.6 and (american.operated_winter, delta.operated_winter) == (20, 19)
    assert american.extra_delay_min == 30.0 and american.extra_taxi_out_min == 1.0
    assert delta.extra_delay_min is None and delta.median_delay_winter_min == 32.0
    assert (other.departures_before, other.operated_winter, other.median_delay_normal_min) == (0, 0, 2.0)

    rates = {r.airline_group: r for r in reports.airline_rates(onset, PARAMS).collect()}
    assert rates["American"].weather_reason_share == 1.0 and rates["American"].departures == 80


def test_window_edges(spark):
    rows = [("e", "DFW", "AA", False, None, False, "none", 0.0, 0.0, h) for h in
            (datetime(2024, 2, 7, 4), datetime(2024, 2, 7, 5), datetime(2024, 2, 8, 4), ONSET,
             datetime(2024, 2, 8, 9), datetime(2024, 2, 8, 10))]
    flights = marts.with_airline_group(spark.createDataFrame(rows, FLIGHTS), airline_groups_frame(spark))
    row = marts.airline_windows(marts.onset_flights(flights, summary(spark), PARAMS)).collect()[0]
    assert (row.departures_before, row.departures_during) == (2, 2)


def test_delay_threshold(spark):
    """Median 0.1 and deviation 0.02 over the normal days; one day stands out by delays only."""
    rates = [8, 10, 10, 12, 6, 14, 40]
    rows = []
    for i, late in enumerate(rates):
        day = datetime(2024, 2, 12 + i)
        rows.append(("e", "DFW", day, 100, 0, 0, 0, 0, late, False, 1.0, "rain" if i else "none"))
    columns = ("event_id string, airport_code string, weather_hour timestamp_ntz, scheduled_departures long, cancelled long, "
               "cancelled_weather long, cancelled_carrier long, cancelled_nas long, delayed_15 long, has_winter_precip boolean, "
               "temp_c double, weather_group string")
    storms = spark.createDataFrame([], STORMS)
    days = reports.day_rates(spark.createDataFrame(rows, columns), storms, PARAMS)
    row = reports.delay_mad_threshold(days, PARAMS).collect()[0]
    assert row.normal_delay_rate == 0.1 and row.delay_mad == pytest.approx(0.02)
    assert row.delay_threshold == pytest.approx(0.1 + 3 * 1.4826 * 0.02)
    assert row.delay_only_days == 1


def test_pivot_keeps_missing_categories(spark):
    rows = [("e", "snow", True), ("e", "snow", False), ("f", "none", False), ("f", None, True)]
    flights = spark.createDataFrame(rows, "event_id string, weather_group string, is_cancelled boolean")
    wide = reports.rates_by_weather_pivot(flights, ["e", "f"]).collect()
    assert [r.weather_group for r in wide] == ["freezing_rain", "ice_pellets", "snow", "rain", "fog", "none"]
    assert (wide[2].departures_e, wide[2].cancellation_rate_e, wide[2].departures_f) == (2, 0.5, None)
    assert wide[0].departures_e is None and wide[5].departures_f == 1


def test_day_expansion_equals_range_join(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-30', date'2024-03-02', interval 1 day)) AS d")
    events = events_frame(spark, [EVENT])
    attached = hourly.attach_event(days, events, "d").select("d", "event_id")
    between = days.join(events, days.d.between(events.data_start, events.data_end), "left").select("d", "event_id")
    assert sorted(map(str, attached.collect())) == sorted(map(str, between.collect()))
