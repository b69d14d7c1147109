"""Weather episodes and the response of operations, per event and station.

Input is one row per event, station and hour, so a group holds at most the hours of one data window:
its size is bounded by the calendar, not by data volume. All windows and roll-ups of a chain share
the (event, station) partitioning and run after a single shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nimbusops.config import Params
from nimbusops.functions import times, values

PAIR = ("event_id", "airport_code")


def search_window(hours: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Event hours with `in_search`: from some days before the storm window to some days after it."""
    bounds = events.select(
        "event_id",
        (F.col("storm_start").cast("timestamp_ntz") - times.days(params.search_pad_days)).alias("_from"),
        (F.col("storm_end").cast("timestamp_ntz") + times.days(1 + params.search_pad_days)).alias("_to"),
    )
    hour = F.col("weather_hour")
    joined = hours.join(bounds, "event_id")
    return joined.withColumn("in_search", (hour >= F.col("_from")) & (hour < F.col("_to"))).drop("_from", "_to")


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, min_gap_h: int, out: str) -> DataFrame:
    """Number the sessions of each key: a row starts a new one when it is the first or comes
    `min_gap_h` hours or more after the previous row. Expects one row per key and hour."""
    ordered = W.partitionBy(*keys).orderBy(ts)
    gap = times.hours_between(F.lag(ts).over(ordered), F.col(ts))
    return df.withColumn("_gap", gap).withColumn(
        out, F.sum(F.when(F.col("_gap") < min_gap_h, 0).otherwise(1)).over(ordered)).drop("_gap")


def consecutive_runs(df: DataFrame, keys: Sequence[str], ts: str, out: str = "run_number") -> DataFrame:
    """Sessions that end at the first missing hour."""
    return gap_sessions(df, keys, ts, 2, out)


def winter_hours(hours: DataFrame, params: Params) -> DataFrame:
    """Winter hours of the search window with episode and run numbers."""
    winter = hours.where("in_search and has_winter_precip").select(*PAIR, "weather_hour")
    episodes = gap_sessions(winter, PAIR, "weather_hour", params.episode_gap_h, "episode_number")
    return consecutive_runs(episodes, PAIR, "weather_hour")


def run_sizes(numbered: DataFrame, *levels: str) -> DataFrame:
    return numbered.groupBy(*PAIR, *levels, "run_number").agg(
        F.min("weather_hour").alias("run_start"), F.max("weather_hour").alias("run_end"),
        F.count("*").alias("run_hours"))


def episode_sizes(numbered: DataFrame, params: Params) -> DataFrame:
    """Episodes with their bounds, hours and the start of the first run that is long enough."""
    runs = run_sizes(numbered, "episode_number")
    sustained = F.min(F.when(F.col("run_hours") >= params.sustained_h, F.col("run_start")))
    return runs.groupBy(*PAIR, "episode_number").agg(
        F.min("run_start").alias("episode_start"), F.max("run_end").alias("episode_end"),
        F.sum("run_hours").alias("episode_hours"), sustained.alias("sustained_onset"))


def main_session(episodes: DataFrame) -> DataFrame:
    """The episode with the most hours, the earliest of equals, and the number of episodes."""
    size = F.struct("episode_hours", -F.col("episode_number"))
    main = F.max_by(F.struct("episode_start", "episode_end", "sustained_onset"), size)
    return episodes.groupBy(*PAIR).agg(main.alias("_main"), F.count("*").alias("n_winter_episodes")).select(
        *PAIR, F.col("_main.episode_start").alias("storm_onset"), F.col("_main.episode_end").alias("precip_end"),
        "n_winter_episodes", F.col("_main.sustained_onset").alias("sustained_onset"))


def storm_bounds(hours: DataFrame, params: Params) -> DataFrame:
    """Onset, end, sustained onset and episode count per event and station: one shuffle in all."""
    return main_session(episode_sizes(winter_hours(hours, params), params))


def with_bounds(hours: DataFrame, bounds: DataFrame) -> DataFrame:
    return hours.join(bounds, list(PAIR), "left")


def first_mass_hour(params: Params) -> Column:
    """Aggregate: first busy hour of the search window, not long before the onset, with mass cancellation."""
    hour, onset = F.col("weather_hour"), F.col("storm_onset")
    mass = (
        F.col("in_search")
        & (hour >= onset - times.hours(params.lookback_h))
        & (F.col("scheduled_departures") >= params.busy_departures)
        & (F.col("cancellation_rate") >= params.mass_rate)
    )
    return F.min(F.when(mass, hour))


def with_recovery(bounded: DataFrame, params: Params) -> DataFrame:
    """Add `recovery_hour`: the first busy hour after the precipitation that starts a complete frame
    of busy hours, all with a low cancellation rate. Frames count rows, so quiet hours do not break
    them, and they are not limited to the search window.

    Busy hours sort before all others, so a frame whose rows all pass holds consecutive busy hours.
    """
    busy = (F.col("weather_hour") > F.col("precip_end")) & (F.col("scheduled_departures") >= params.busy_departures)
    pair = W.partitionBy(*PAIR)
    frame = pair.orderBy(F.desc("_busy"), "weather_hour").rowsBetween(0, params.recovery_rows - 1)
    calm = F.col("_busy") & (F.col("cancellation_rate") < params.recovery_rate)
    return (
        bounded.withColumn("_busy", F.coalesce(busy, F.lit(False)))
        .withColumn("_stable", F.count_if(calm).over(frame) == params.recovery_rows)
        .withColumn("recovery_hour", F.min(F.when(F.col("_stable"), F.col("weather_hour"))).over(pair))
        .drop("_busy", "_stable")
    )


def window_totals(params: Params) -> list[Column]:
    """Aggregates over all event hours with `recovery_hour`: the episode, the hours before it and the disruption."""
    hour, onset, end = F.col("weather_hour"), F.col("storm_onset"), F.col("precip_end")
    episode = hour.between(onset, end)
    before = (hour >= onset - times.hours(params.lookback_h)) & (hour < onset)
    until = F.coalesce(F.col("recovery_hour"), end + times.hours(1))
    disruption = (hour >= onset) & (hour < until)

    def hours_with(flag: str) -> Column:
        return values.count_where(episode & F.col(flag))

    return [
        hours_with("has_winter_precip").alias("winter_precip_hours"),
        hours_with("has_freezing_rain").alias("freezing_rain_hours"),
        hours_with("has_ice_pellets").alias("ice_pellets_hours"),
        hours_with("has_snow").alias("snow_hours"),
        F.min("temp_min_c").alias("min_temp_c"),
        F.max("ice_accretion_max_mm").alias("max_ice_accretion_mm"),
        F.min(F.when(episode, F.col("temp_min_c"))).alias("episode_min_temp_c"),
        F.max(F.when(episode, F.col("ice_accretion_max_mm"))).alias("episode_max_ice_accretion_mm"),
        values.sum_where(before, F.col("scheduled_departures")).alias("pre_onset_departures"),
        values.sum_where(before, F.col("cancelled")).alias("pre_onset_cancelled"),
        values.sum_where(disruption, F.col("scheduled_departures")).alias("disruption_departures"),
        values.sum_where(disruption, F.col("cancelled")).alias("disruption_cancelled"),
        values.sum_where(disruption, F.col("cancelled_weather")).alias("disruption_cancelled_weather"),
    ]
