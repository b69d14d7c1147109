import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nimbusops.config import Event, Params, events_frame
from nimbusops.operators import episodes
from nimbusops.plans import marts

START = datetime(2021, 2, 1)
EVENT = Event("e", "Event", "E", date(2021, 2, 1), date(2021, 2, 28), date(2021, 2, 8), date(2021, 2, 10))
PARAMS = Params()
SCHEMA = (
    "event_id string, airport_code string, weather_hour timestamp_ntz, scheduled_departures long, cancelled long, "
    "cancelled_weather long, cancellation_rate double, has_winter_precip boolean, has_freezing_rain boolean, "
    "has_ice_pellets boolean, has_snow boolean, temp_min_c double, ice_accretion_max_mm double"
)


def summary_of(spark, winter, traffic=None, airport="DFW"):
    """Summary for winter hours and (scheduled, cancelled) traffic by hour offset from 1 February."""
    traffic = traffic or {}
    rows = []
    for i in range(28 * 24):
        scheduled, cancelled = traffic.get(i, (10, 0))
        rate = round(cancelled / scheduled, 4) if scheduled else None
        wet = i in winter
        rows.append(("e", airport, START + timedelta(hours=i), scheduled, cancelled, cancelled // 2, rate, wet, False, False,
                     wet, float(-i % 50), None))
    hours = spark.createDataFrame(rows, SCHEMA)
    response = marts.storm_response(hours, events_frame(spark, [EVENT]), PARAMS)
    return marts.storm_summary(response).collect()[0]


def hour(i):
    return START + timedelta(hours=i)


DAY8 = 7 * 24  # first hour of the storm window


def test_gap_of_exactly_24_hours_starts_an_episode(spark):
    one = summary_of(spark, {DAY8, DAY8 + 23})
    assert (one.n_winter_episodes, one.precip_end) == (1, hour(DAY8 + 23))
    two = summary_of(spark, {DAY8, DAY8 + 24})
    assert (two.n_winter_episodes, two.storm_onset, two.precip_end) == (2, hour(DAY8), hour(DAY8))


def test_largest_episode_wins_and_the_earlier_of_equals(spark):
    equal = summary_of(spark, {*range(DAY8, DAY8 + 5), *range(DAY8 + 40, DAY8 + 45)})
    assert equal.storm_onset == hour(DAY8)
    later = summary_of(spark, {*range(DAY8, DAY8 + 5), *range(DAY8 + 40, DAY8 + 46)})
    assert (later.storm_onset, later.winter_precip_hours) == (hour(DAY8 + 40), 6)


def test_sustained_onset_needs_six_hours_of_the_main_episode(spark):
    assert summary_of(spark, set(range(DAY8, DAY8 + 5))).sustained_onset is None
    light_first = summary_of(spark, {DAY8, *range(DAY8 + 3, DAY8 + 9)})
    assert (light_first.storm_onset, light_first.sustained_onset) == (hour(DAY8), hour(DAY8 + 3))
    # a run of six in a smaller episode does not count
    scattered = set(range(DAY8 + 40, DAY8 + 56, 2))
    assert summary_of(spark, {*range(DAY8, DAY8 + 6), *scattered}).sustained_onset is None


def test_search_window_limits_winter_hours(spark):
    first, last = 4 * 24, 13 * 24 - 1  # three days before and after the storm dates
    inside = summary_of(spark, {first - 1, first, last, last + 1})
    assert inside.n_winter_episodes == 2 and inside.storm_onset == hour(first)


def test_mass_cancellation(spark):
    winter = set(range(DAY8, DAY8 + 10))
    assert summary_of(spark, winter, {DAY8 - 2: (10, 6)}).lag_to_mass_cancel_h == -2
    assert summary_of(spark, winter, {DAY8 - 24: (10, 5)}).lag_to_mass_cancel_h == -24
    assert summary_of(spark, winter, {DAY8 - 30: (10, 6), DAY8 + 4: (10, 5)}).lag_to_mass_cancel_h == 4
    assert summary_of(spark, winter, {DAY8 + 1: (2, 2)}).first_mass_cancel_hour is None
    assert summary_of(spark, winter, {20 * 24: (10, 9)}).first_mass_cancel_hour is None, "outside the search window"


def test_recovery_counts_busy_hours(spark):
    winter = set(range(DAY8, DAY8 + 10))
    end = DAY8 + 9
    quiet_between = {i: (10, 5) for i in range(DAY8, end + 4)} | {end + 6: (2, 2)}
    found = summary_of(spark, winter, quiet_between)
    assert (found.recovery_hour, found.recovery_h) == (hour(end + 4), 4)
    last = 28 * 24
    five_left = {i: (10, 1) for i in range(end + 1, last - 5)}
    assert summary_of(spark, winter, five_left).recovery_hour is None, "0.1 is not below the limit and five hours are too few"
    six_left = {i: (10, 1) for i in range(end + 1, last - 6)}
    assert summary_of(spark, winter, six_left).recovery_hour == hour(last - 6)


def test_totals_without_recovery_end_with_the_precipitation(spark):
    winter = set(range(DAY8, DAY8 + 3))
    traffic = {i: (10, 4) for i in range(DAY8, 28 * 24)} | {i: (5, 1) for i in range(DAY8 - 24, DAY8)}
    row = summary_of(spark, winter, traffic)
    assert row.recovery_hour is None
    assert (row.disruption_departures, row.disruption_cancelled, row.weather_reason_share) == (30, 12, 0.5)
    assert (row.pre_onset_departures, row.pre_onset_cancelled, row.pre_onset_cancel_rate) == (120, 24, 0.2)
    assert row.min_temp_c == 0.0 and row.max_ice_accretion_mm is None


def test_pair_without_winter_hours_stays(spark):
    row = summary_of(spark, set())
    assert row.airport_code == "DFW" and row.storm_airport_id
    unknown = [c for c in row.asDict() if c not in ("storm_airport_id", "event_id", "airport_code")]
    assert all(row[c] is None for c in unknown)


def test_sessions_match_a_loop(spark):
    rng = random.Random(7)
    rows = sorted({(k, rng.randrange(0, 3000)) for k in "aab" for _ in range(400)})
    frame = spark.createDataFrame([(k, START + timedelta(hours=h)) for k, h in rows], "k string, ts timestamp_ntz")
    got = {(r.k, r.ts): r.s for r in episodes.gap_sessions(frame, ["k"], "ts", 12, "s").collect()}
    number, previous = 0, None
    for k, h in rows:
        if previous is None or previous[0] != k:
            number = 1
        elif h - previous[1] >= 12:
            number += 1
        assert got[(k, START + timedelta(hours=h))] == number
        previous = (k, h)


@pytest.mark.parametrize("min_gap, sessions", [(2, 3), (3, 2), (25, 1)])
def test_gap_is_a_parameter(spark, min_gap, sessions):
    frame = spark.createDataFrame([("k", START + timedelta(hours=h)) for h in (0, 1, 3, 27)], "k string, ts timestamp_ntz")
    assert episodes.gap_sessions(frame, ["k"], "ts", min_gap, "s").agg(F.max("s")).collect()[0][0] == sessions
