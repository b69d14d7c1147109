"""The result tables per event and station: summary, timeline, airline groups, days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.config import Params
from nimbusops.functions import times, values
from nimbusops.operators import episodes, hourly, medians

PAIR = list(episodes.PAIR)
GROUP = [*PAIR, "airline_group"]
DAY = [*PAIR, "day"]


# --- storm summary -----------------------------------------------------------------------------

def storm_response(airport_hours: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Bounds, first mass hour, recovery and window totals per event and station of the search window.

    Reads the hourly table twice (once for the bounds, once for everything else) and shuffles each
    read once; pairs without winter hours stay, with unknown metrics.
    """
    hours = episodes.search_window(airport_hours.where("event_id is not null"), events, params)
    bounds = episodes.storm_bounds(hours, params)
    bounded = episodes.with_recovery(episodes.with_bounds(hours, bounds), params)
    totals = episodes.window_totals(params)
    found = ["storm_onset", "precip_end", "n_winter_episodes", "sustained_onset", "recovery_hour"]
    response = bounded.groupBy(*PAIR, *found).agg(
        F.bool_or("in_search").alias("_searched"),
        episodes.first_mass_hour(params).alias("first_mass_cancel_hour"),
        *totals,
    ).where("_searched")
    has_storm = F.col("storm_onset").isNotNull()
    metrics = [c for c in response.columns if c not in (*PAIR, *found, "_searched")]
    return response.select(*PAIR, *found, *[F.when(has_storm, F.col(m)).alias(m) for m in metrics])


def storm_summary(response: DataFrame) -> DataFrame:
    """One row per event and station: timing, weather totals, lags and rates."""
    def hours_since(start: str, end: str) -> Column:
        return times.hours_between(F.col(start), F.col(end))

    return response.select(
        values.surrogate_key(*PAIR).alias("storm_airport_id"),
        *PAIR,
        "storm_onset",
        "precip_end",
        (hours_since("storm_onset", "precip_end") + 1).alias("storm_duration_h"),
        "n_winter_episodes",
        "winter_precip_hours", "freezing_rain_hours", "ice_pellets_hours", "snow_hours",
        "min_temp_c", "max_ice_accretion_mm", "episode_min_temp_c", "episode_max_ice_accretion_mm",
        "sustained_onset",
        "first_mass_cancel_hour",
        hours_since("storm_onset", "first_mass_cancel_hour").alias("lag_to_mass_cancel_h"),
        hours_since("sustained_onset", "first_mass_cancel_hour").alias("lag_from_sustained_h"),
        "recovery_hour",
        hours_since("precip_end", "recovery_hour").alias("recovery_h"),
        "pre_onset_departures", "pre_onset_cancelled",
        values.rate(F.col("pre_onset_cancelled"), F.col("pre_onset_departures")).alias("pre_onset_cancel_rate"),
        "disruption_departures", "disruption_cancelled",
        values.rate(F.col("disruption_cancelled"), F.col("disruption_departures")).alias("disruption_cancel_rate"),
        values.rate(F.col("disruption_cancelled_weather"), F.col("disruption_cancelled")).alias("weather_reason_share"),
    )


def onset_bounds(summary: DataFrame) -> DataFrame:
    """The zero hour of each pair with a storm: the sustained onset, else the first winter hour."""
    return summary.where("storm_onset is not null").select(
        *PAIR,
        F.coalesce("sustained_onset", "storm_onset").alias("onset_hour"),
        F.col("sustained_onset").isNotNull().alias("has_sustained_onset"),
        "precip_end", "recovery_h",
    )


# --- timeline ----------------------------------------------------------------------------------

def storm_timeline(airport_hours: DataFrame, summary: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Hours around the onset on a common axis, with phase and bin."""
    storms = onset_bounds(summary).join(events.select("event_id", "event_name"), "event_id")
    hour, onset, end = F.col("weather_hour"), F.col("onset_hour"), F.col("precip_end")
    recovering = F.col("recovery_h").isNull() | (hour < times.plus_hours(end, F.col("recovery_h")))
    phase = values.first_label(
        [(hour < onset, "before"), (hour <= end, "precipitation"), (recovering, "recovery")], "normal")
    offset = times.hours_between(onset, hour)
    around = (hour >= onset - times.hours(params.hours_before)) & (hour < onset + times.hours(params.hours_after))
    return airport_hours.join(storms, PAIR).where(around).select(
        "airport_hour_id", "event_id", "event_name", "airport_code", "weather_hour", "onset_hour",
        "has_sustained_onset",
        offset.alias("hours_from_onset"),
        (F.floor(offset / params.bin_h) * params.bin_h).cast("int").alias("hours_from_onset_3h"),
        phase.alias("storm_phase"),
        "scheduled_departures", "cancelled",
        (F.col("scheduled_departures") - F.col("cancelled")).alias("operated_departures"),
        "delayed_15", "cancellation_rate",
        (F.col("scheduled_departures") >= params.busy_departures).alias("is_busy_hour"),
        "has_winter_precip", "weather_group", "temp_c",
    )


# --- airline groups ----------------------------------------------------------------------------

def with_airline_group(flights: DataFrame, groups: DataFrame) -> DataFrame:
    named = flights.join(groups.select("airline_code", "airline_group"), "airline_code", "left")
    return named.fillna(fixed.OTHER_GROUP, ["airline_group"])


def onset_flights(departures: DataFrame, summary: DataFrame, params: Params) -> DataFrame:
    """Departures from some hours before the onset to the end of precipitation, with `is_before`."""
    hour = F.col("scheduled_dep_hour")
    bounds = onset_bounds(summary).withColumnRenamed("airport_code", "origin_airport")
    joined = departures.join(bounds, ["event_id", "origin_airport"]).where(
        (hour >= F.col("onset_hour") - times.hours(params.lookback_h)) & (hour <= F.col("precip_end")))
    return joined.withColumn("is_before", hour < F.col("onset_hour")).withColumnRenamed("origin_airport", "airport_code")


def airline_windows(flights: DataFrame) -> DataFrame:
    """Departures and cancellations before and during the precipitation per airline group."""
    before, cancelled = F.col("is_before"), F.col("is_cancelled")
    return flights.groupBy(*GROUP).agg(
        values.count_where(before).alias("departures_before"),
        values.count_where(before & cancelled).alias("cancelled_before"),
        values.count_where(~before).alias("departures_during"),
        values.count_where(~before & cancelled).alias("cancelled_during"),
    )


def operated_by_condition(flights: DataFrame) -> DataFrame:
    """Operated flights in winter hours or in hours without any phenomenon, as `conditions`."""
    winter = F.coalesce("has_winter_precip", F.lit(False))
    return (
        flights.where(~F.col("is_cancelled") & (winter | (F.col("weather_group") == "none")))
        .withColumn("conditions", F.when(winter, "winter").otherwise("normal"))
        .withColumnRenamed("origin_airport", "airport_code")
    )


CONDITION_METRICS = ["dep_delay_min", "taxi_out_min"]


def condition_histogram(flights: DataFrame, keys: list[str]) -> DataFrame:
    """Value counts of delay and taxi-out per key and conditions: the only pass over flight rows. Flights
    outside all events count under a NULL event."""
    return medians.value_histogram(operated_by_condition(flights), [*keys, "conditions"], CONDITION_METRICS)


def condition_medians(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Operated flights and median delay and taxi-out per key, winter and normal hours side by side."""
    per_condition = medians.histogram_medians(histogram, [*keys, "conditions"], CONDITION_METRICS)
    measures = {"operated": "rows", "median_delay": "median_dep_delay_min", "median_taxi_out": "median_taxi_out_min"}
    return per_condition.groupBy(*keys).agg(*[
        F.max(F.when(F.col("conditions") == c, F.col(source))).alias(f"{name}_{c}")
        for name, source in measures.items() for c in ("normal", "winter")])


def winter_normal_medians(histogram: DataFrame) -> DataFrame:
    """Operated winter flights and the medians in winter and normal hours per airline group."""
    return condition_medians(histogram, GROUP).select(
        *GROUP,
        values.or_zero(F.col("operated_winter")).alias("operated_winter"),
        F.col("median_delay_winter").alias("median_delay_winter_min"),
        F.col("median_delay_normal").alias("median_delay_normal_min"),
        F.col("median_taxi_out_winter").alias("median_taxi_out_winter_min"),
        F.col("median_taxi_out_normal").alias("median_taxi_out_normal_min"),
    )


def airline_storm(windows: DataFrame, operated: DataFrame, params: Params) -> DataFrame:
    """Airline groups seen around the onset or operating at all, with low-sample suppression. Groups outside
    all events have a NULL event, no counts around an onset and no id."""
    # a full join holds the union of both key sets and evaluates each input once
    joined = windows.join(operated, GROUP, "full")
    counts = ["departures_before", "cancelled_before", "departures_during", "cancelled_during"]

    def window_rate(period: str) -> Column:
        departures, cancelled = F.col(f"departures_{period}"), F.col(f"cancelled_{period}")
        return values.if_enough(departures, params.min_group_departures, values.ratio(cancelled, departures))

    def extra(measure: str) -> Column:
        difference = F.col(f"median_{measure}_winter_min") - F.col(f"median_{measure}_normal_min")
        return values.if_enough(F.col("operated_winter"), params.min_group_operated, difference)

    return joined.select(
        F.concat("event_id", F.lit("_"), "airport_code", F.lit("_"), "airline_group").alias("airline_storm_id"),
        *GROUP,
        *[values.or_zero(F.col(c)).alias(c) for c in counts],
        window_rate("before").alias("cancel_rate_before"),
        window_rate("during").alias("cancel_rate_during"),
        values.or_zero(F.col("operated_winter")).alias("operated_winter"),
        "median_delay_winter_min", "median_delay_normal_min",
        extra("delay").alias("extra_delay_min"),
        extra("taxi_out").alias("extra_taxi_out_min"),
    )


# --- days --------------------------------------------------------------------------------------

def daily_departures(airport_hours: DataFrame) -> DataFrame:
    counts = {"departures": "scheduled_departures", "cancelled": "cancelled", "cancelled_weather": "cancelled_weather",
              "cancelled_carrier": "cancelled_carrier", "cancelled_nas": "cancelled_nas", "delayed_15": "delayed_15"}
    days = airport_hours.groupBy(*PAIR, F.to_date("weather_hour").alias("day"))
    return days.agg(*[F.sum(source).alias(name) for name, source in counts.items()])


def daily_weather(weather: DataFrame) -> DataFrame:
    return weather.groupBy("airport_code", F.to_date("weather_hour").alias("day")).agg(
        values.count_where(F.col("has_winter_precip")).alias("winter_hours"),
        values.count_where(F.col("has_thunder")).alias("thunder_hours"),
        values.count_where(F.col("has_rain")).alias("rain_hours"),
        F.min("temp_c").alias("min_temp_c"),
        F.max("wind_gust_max_kmh").alias("max_gust_kmh"),
        F.min("visibility_min_km").alias("min_visibility_km"),
    )


def daily_arrivals(flights: DataFrame) -> DataFrame:
    arriving = flights.where("is_arrival and scheduled_arr_ts is not null")
    return arriving.groupBy(F.col("dest_airport").alias("airport_code"), F.to_date("scheduled_arr_ts").alias("day")).agg(
        F.count("*").alias("arrivals"), values.count_where(F.col("is_diverted")).alias("diverted_arrivals"))


def normal_diversions(arrivals: DataFrame) -> DataFrame:
    """Median diverted arrivals per station and calendar year; a group has at most 366 days."""
    return arrivals.groupBy("airport_code", F.year("day").alias("year")).agg(
        F.median("diverted_arrivals").alias("normal_diverted_arrivals"))


def storm_days(summary: DataFrame, params: Params) -> DataFrame:
    """First and last day of the storm period: the day before the onset to the end of recovery."""
    recovery = F.coalesce(F.col("recovery_h"), F.lit(params.recovery_fallback_h))
    return summary.where("storm_onset is not null").select(
        *PAIR,
        F.date_sub(F.to_date("storm_onset"), 1).alias("storm_first_day"),
        F.to_date(times.plus_hours(F.col("precip_end"), recovery)).alias("storm_last_day"),
    )


def station_days(departures: DataFrame, storms: DataFrame, weather: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Days with departures next to storm period, weather and arrivals. All inputs are daily totals."""
    at_day = ["airport_code", "day"]
    joined = departures.join(storms, PAIR, "left").join(weather, at_day, "left").join(arrivals, at_day, "left")
    counted = ["winter_hours", "thunder_hours", "rain_hours", "arrivals", "diverted_arrivals"]
    return joined.fillna(0, counted).withColumn(
        "in_storm", values.within(F.col("day"), F.col("storm_first_day"), F.col("storm_last_day")))


def is_unusual(rate: Column, params: Params) -> Column:
    enough = F.col("departures") >= params.min_day_departures
    return ~F.col("in_storm") & enough & (rate >= params.unusual_rate)


def explanation(thunder: str, elsewhere: str) -> Column:
    return values.first_label(
        [(F.col("winter_hours") > 0, fixed.LOCAL_WINTER), (F.col("thunder_hours") > 0, thunder)], elsewhere)


def main_reason(params: Params) -> Column:
    """The reason with most cancellations; weather before carrier before nas on a tie."""
    weather, carrier, nas = (F.col(f"cancelled_{r}") for r in ("weather", "carrier", "nas"))
    label = values.first_label(
        [((weather >= carrier) & (weather >= nas), "weather"), (carrier >= nas, "carrier")], "nas")
    return values.if_enough(F.col("cancelled"), params.min_reason_cancelled, label)


def airport_daily(departures: DataFrame, storms: DataFrame, weather: DataFrame, arrivals: DataFrame,
                  events: DataFrame, params: Params) -> DataFrame:
    """Days of the event windows; the flag uses the rounded rate, the diversion baseline all days of the year."""
    days = station_days(departures.where("event_id is not null"), storms, weather, arrivals)
    days = days.join(events.select("event_id", "event_name"), "event_id", "left").withColumn("year", F.year("day"))
    days = days.join(normal_diversions(arrivals), ["airport_code", "year"], "left")
    rated = days.withColumn("cancel_rate", values.rate(F.col("cancelled"), F.col("departures")))
    flagged = rated.withColumn("is_unusual", F.coalesce(is_unusual(F.col("cancel_rate"), params), F.lit(False)))
    aligned = F.make_date(F.lit(params.aligned_year), F.month("day"), F.dayofmonth("day"))
    return flagged.select(
        values.surrogate_key(*DAY).alias("airport_day_id"),
        "event_id", "event_name", "airport_code", "day",
        aligned.alias("aligned_day"),
        "departures", "cancelled", "cancel_rate", "cancelled_weather", "cancelled_carrier", "cancelled_nas",
        "delayed_15",
        main_reason(params).alias("main_cancel_reason"),
        "storm_first_day", "storm_last_day",
        F.col("in_storm").alias("is_storm_period"),
        "is_unusual",
        F.when(F.col("is_unusual"), explanation(*fixed.UNUSUAL_REASONS)).alias("unusual_reason"),
        "winter_hours", "thunder_hours", "rain_hours", "min_temp_c", "max_gust_kmh", "min_visibility_km",
        "arrivals", "diverted_arrivals", "normal_diverted_arrivals",
    )


def baseline(measure: Column, normal: Column) -> Column:
    """Median of a measure over the normal days of the event and station; a group holds at most the
    days of one data window. Days outside all events have no baseline."""
    middle = F.median(F.when(normal, measure)).over(W.partitionBy(*PAIR))
    return F.when(F.col("event_id").isNotNull(), middle)


def unusual_days(departures: DataFrame, storms: DataFrame, weather: DataFrame, arrivals: DataFrame,
                 params: Params) -> DataFrame:
    """All station days with the exact rate and medians of the event's normal days as baseline."""
    days = station_days(departures, storms, weather, arrivals)
    rated = days.withColumn("cancel_rate", values.ratio(F.col("cancelled"), F.col("departures")))
    enough = F.col("departures") >= params.min_day_departures
    normal = ~F.col("in_storm") & (F.col("winter_hours") == 0) & enough
    flagged = rated.withColumns({
        "normal_cancel_rate": baseline(F.col("cancel_rate"), normal),
        "normal_diverted_arrivals": baseline(F.col("diverted_arrivals"), normal),
        "is_unusual": is_unusual(F.col("cancel_rate"), params),
    })
    label = explanation(*fixed.UNUSUAL_EXPLANATIONS)
    return flagged.select(
        F.concat("airport_code", F.lit("_"), F.col("day").cast("string")).alias("airport_day_id"),
        "event_id", "airport_code", F.col("day").alias("flight_day"),
        "departures", "cancelled", "cancelled_weather", "cancelled_carrier", "cancelled_nas", "delayed_15",
        "storm_first_day", "storm_last_day", "in_storm", "cancel_rate",
        "winter_hours", "thunder_hours", "max_gust_kmh", "min_visibility_km",
        "arrivals", "diverted_arrivals", "normal_cancel_rate", "normal_diverted_arrivals", "is_unusual",
        F.when(F.col("is_unusual"), label).alias("unusual_explanation"),
    )
