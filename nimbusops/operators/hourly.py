"""Station-hour tables: the only operators, with the flight-grain join, that see raw volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.config import Params
from nimbusops.functions import codes, times, values

HOUR = ("airport_code", "weather_hour")

# Weather columns of the hour that the hourly and flight marts carry.
HOUR_WEATHER = (
    "weather_group", "has_winter_precip", "has_freezing_rain", "has_ice_pellets", "has_snow",
    "temp_c", "temp_min_c", "precip_mm", "ice_accretion_max_mm", "visibility_min_km", "wind_gust_max_kmh",
)


def assign_hour(reports: DataFrame, shift_min: int) -> DataFrame:
    """The hour a report describes: routine reports are issued shortly before the hour they stand for."""
    shifted = F.col("valid_local") + times.minutes(shift_min)
    return reports.withColumn("weather_hour", times.trunc("hour", shifted))


def parse_weather_codes(reports: DataFrame) -> DataFrame:
    """Report-level code text and phenomenon flags."""
    text = codes.station_codes_text(F.col("weather_codes"))
    return reports.withColumn("codes_text", text).withColumns(codes.text_flags(F.col("codes_text")))


def hourly_observations(reports: DataFrame, params: Params) -> DataFrame:
    """One row per station and hour that has a report, with the first and last local month of its reports.

    Reports are reduced to one row per hour and raw code text first, in fixed-size buffers that combine
    map-side; only these rows are collected into the hour's set of texts, which is then parsed once per
    hour. So neither a set nor a regular expression sees raw rows. A value of the hour is the last
    known one of the routine reports.
    """
    routine = F.col("report_type") == fixed.ROUTINE
    month = times.trunc("month", F.col("valid_local"))
    last = ("temp_c", "dewpoint_c", "precip_mm")
    known = {name: F.when(routine & F.col(name).isNotNull(), F.col("valid_utc")) for name in last}
    least = {"temp_min_c": "temp_c", "visibility_min_km": "visibility_km"}
    most = {"wind_speed_max_kmh": "wind_speed_kmh", "wind_gust_max_kmh": "wind_gust_kmh",
            "ice_accretion_max_mm": "ice_accretion_1h_mm"}
    per_text = assign_hour(reports, params.hour_shift_min).groupBy(*HOUR, "weather_codes").agg(
        F.count("*").alias("n_reports"),
        values.count_where(F.col("report_type") == fixed.SPECIAL).alias("n_special_reports"),
        *[F.max_by(name, known[name]).alias(name) for name in last],
        *[F.max(known[name]).alias(f"_at_{name}") for name in last],
        *[F.min(source).alias(name) for name, source in least.items()],
        *[F.max(source).alias(name) for name, source in most.items()],
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
    )
    per_hour = per_text.groupBy(*HOUR).agg(
        *[F.sum(name).alias(name) for name in ("n_reports", "n_special_reports")],
        *[F.max_by(name, f"_at_{name}").alias(name) for name in last],
        *[F.min(name).alias(name) for name in least],
        *[F.max(name).alias(name) for name in most],
        F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"),
        F.collect_set("weather_codes").alias("_codes"),
    )
    texts = F.array_sort(F.array_distinct(F.transform("_codes", codes.station_codes_text)))
    parsed = per_hour.withColumn("_texts", F.filter(texts, lambda text: text != ""))
    return (
        parsed.withColumns(codes.any_text_flags(F.col("_texts")))
        .withColumn("weather_codes_hour", F.nullif(F.array_join("_texts", " | "), F.lit("")))
        .drop("_codes", "_texts")
    )


def report_months(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct local months per key, from the hourly table. Months come from report times, not from
    shifted hours, so an hour may hold reports of two months, and never of more."""
    months = F.explode(F.array("first_month", "last_month"))
    return hourly.select(*keys, months.alias("month_start")).distinct()


def local_months(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct local months per key, from the reports themselves."""
    return reports.select(*keys, times.trunc("month", F.col("valid_local")).alias("month_start")).where("month_start IS NOT NULL").distinct()


def hour_grid(months: DataFrame, keys: Sequence[str], extend: bool = False) -> DataFrame:
    """Every hour of each month, without gaps. With `extend`, the midnight after the last of consecutive
    months belongs to the grid, so that a departure at 24:00 has an hour.

    Months become days, which are dealt to tasks by their bytes at run time, and only then hours: so a
    tiny table of months fills as many tasks as its hours need, by one plan at every size.
    """
    start = F.col("month_start")
    next_month = start + F.make_ym_interval(months=F.lit(1))
    last = next_month - times.hours(1)
    if extend:
        following = F.lead("month_start").over(W.partitionBy(*keys).orderBy("month_start"))
        months = months.withColumn("_following", following)
        last = F.when(F.col("_following") == next_month, last).otherwise(next_month)
    days = months.select(*keys, last.alias("_last"), F.explode(F.sequence(start, last, times.days(1))).alias("_day"))
    until = F.least(F.col("_day") + times.hours(23), F.col("_last"))
    return days.hint("rebalance").select(*keys, F.explode(F.sequence("_day", until, times.hours(1))).alias("weather_hour"))


def fill_grid(grid: DataFrame, hourly: DataFrame) -> DataFrame:
    """Dense station-hour weather: hours without reports stay visible, with unknown flags."""
    filled = grid.join(hourly, list(HOUR), "left").withColumn("has_report", F.col("n_reports").isNotNull())
    return filled.select(
        values.surrogate_key(*HOUR).alias("weather_hour_id"),
        *HOUR,
        F.to_date("weather_hour").alias("weather_date"),
        "has_report",
        values.or_zero(F.col("n_reports")).alias("n_reports"),
        values.or_zero(F.col("n_special_reports")).alias("n_special_reports"),
        "temp_c", "dewpoint_c", "temp_min_c", "precip_mm", "wind_speed_max_kmh", "wind_gust_max_kmh",
        "visibility_min_km", "ice_accretion_max_mm",
        *fixed.PHENOMENA,
        codes.winter_precip().alias("has_winter_precip"),
        codes.weather_group(F.col("has_report")).alias("weather_group"),
        "weather_codes_hour",
    )


def hourly_departures(flights: DataFrame) -> DataFrame:
    """Scheduled departures per origin and hour with their outcomes; combined map-side."""
    reason, operated = F.col("cancellation_reason"), ~F.col("is_cancelled")
    return (
        flights.where("is_departure")
        .groupBy(F.col("origin_airport").alias("airport_code"), F.col("scheduled_dep_hour").alias("weather_hour"))
        .agg(
            F.count("*").alias("scheduled_departures"),
            values.count_where(F.col("is_cancelled")).alias("cancelled"),
            *[values.count_where(reason == r).alias(f"cancelled_{r}") for r in ("weather", "carrier", "nas", "security")],
            values.count_where(F.col("is_diverted")).alias("diverted"),
            values.count_where(F.col("is_dep_delayed_15")).alias("delayed_15"),
            F.avg(F.when(operated, F.col("dep_delay_min"))).alias("avg_dep_delay_min"),
            F.avg(F.when(operated, F.col("taxi_out_min"))).alias("avg_taxi_out_min"),
        )
    )


def event_days(events: DataFrame) -> DataFrame:
    """Events, one row per day of the data window, so that range joins become equi-joins."""
    return events.withColumn("_day", F.explode(F.sequence("data_start", "data_end")))


def attach_event(df: DataFrame, events: DataFrame, day: str) -> DataFrame:
    """Left-join the event whose data window holds the day, as a hash join on the day."""
    days = event_days(events)
    return df.join(days, F.col(day) == days["_day"], "left").drop("_day")


def storm_period(ts: str) -> Column:
    """before / storm / after relative to the storm window; 'after' also when there is no event."""
    end = F.col("storm_end").cast("timestamp_ntz") + times.days(1)
    return values.first_label(
        [(F.col(ts) < F.col("storm_start").cast("timestamp_ntz"), "before"), (F.col(ts) < end, "storm")], "after")


def hours_from_storm_start(hour: str) -> Column:
    return times.hours_between(F.col("storm_start").cast("timestamp_ntz"), F.col(hour))


def airport_hourly(weather: DataFrame, departures: DataFrame, events: DataFrame) -> DataFrame:
    """Dense weather hours with departures, event and period.

    Weather and departures are both keyed by station and hour, so their join adds no shuffle of raw
    rows: both sides are already aggregated and partitioned on that key.
    """
    scheduled, cancelled = F.col("scheduled_departures"), F.col("cancelled")
    counts = ["scheduled_departures", "cancelled", "cancelled_weather", "cancelled_carrier", "cancelled_nas",
              "cancelled_security", "diverted", "delayed_15"]
    joined = attach_event(weather.join(departures, list(HOUR), "left"), events, "weather_date")
    return joined.select(
        F.col("weather_hour_id").alias("airport_hour_id"),
        *HOUR,
        "weather_date",
        "event_id",
        storm_period("weather_hour").alias("storm_period"),
        hours_from_storm_start("weather_hour").alias("hours_from_storm_start"),
        *[values.or_zero(F.col(c)).alias(c) for c in counts],
        values.rate(cancelled, scheduled).alias("cancellation_rate"),
        values.rate(F.col("delayed_15"), scheduled - cancelled).alias("delay_15_rate"),
        values.rounded(F.col("avg_dep_delay_min"), 1).alias("avg_dep_delay_min"),
        values.rounded(F.col("avg_taxi_out_min"), 1).alias("avg_taxi_out_min"),
        F.col("has_report").alias("has_weather_report"),
        *HOUR_WEATHER,
    )


def departures_with_event(flights: DataFrame, events: DataFrame) -> DataFrame:
    """Departing flights with the event window they fall into; no weather join."""
    return attach_event(flights.where("is_departure"), events, "flight_date")


def flights_weather(departures: DataFrame, weather: DataFrame) -> DataFrame:
    """Departing flights with the weather of their scheduled hour at the origin.

    Flight grain: one join on (station, hour). Weather hours are unique, so a hot hour is skewed only
    on the flight side, which adaptive execution splits; small weather tables are broadcast by size.
    """
    hours = weather.select(
        F.col("airport_code").alias("origin_airport"), F.col("weather_hour").alias("scheduled_dep_hour"),
        "weather_hour_id", F.col("has_report").alias("has_weather_report"), *HOUR_WEATHER)
    return departures.join(hours, ["origin_airport", "scheduled_dep_hour"], "left").select(
        "flight_id", "flight_date", "airline_code", "flight_number", "origin_airport", "dest_airport",
        "scheduled_dep_ts", "scheduled_dep_hour",
        "event_id", "event_name",
        storm_period("scheduled_dep_ts").alias("storm_period"),
        hours_from_storm_start("scheduled_dep_hour").alias("hours_from_storm_start"),
        "is_cancelled", "cancellation_code", "cancellation_reason", "is_diverted", "dep_delay_min",
        "is_dep_delayed_15", "taxi_out_min", "weather_delay_min", "carrier_delay_min", "nas_delay_min",
        "late_aircraft_delay_min",
        "weather_hour_id", "has_weather_report", *HOUR_WEATHER,
    )
