"""Analysis frames over the marts. Every result is small: pairs, groups, bins or flagged days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nimbusops import fixed_values as fixed
from nimbusops.config import Params, local_frame
from nimbusops.functions import times, values
from nimbusops.plans import marts

PAIR = marts.PAIR


def position(column: str, order: Sequence[str]) -> Column:
    """Sort key of a category in a given order."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))


def in_category_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows by category order, then by event, the latest event name first."""
    return df.orderBy(position(column, order), F.desc("event_id"))


def event_labels(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("label").alias("storm"))


def all_categories(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row per category of the list, in order, with NULLs for the missing ones."""
    rows = [(name, i) for i, name in enumerate(order)]
    wanted = local_frame(df.sparkSession, {column: "string", "_position": "int"}, rows)
    return wanted.join(df, column, "left").orderBy("_position").drop("_position")


def flatten_pivot(df: DataFrame, keys: Sequence[str], column: str, options: Sequence[str],
                  measures: Sequence[str]) -> DataFrame:
    """Long to wide with fixed options: columns `<measure>_<option>`. Expects one row per key and option."""
    wide = df.groupBy(*keys).pivot(column, list(options)).agg(*[F.first(m).alias(m) for m in measures])
    # a single measure gets no suffix from pivot
    names = {(m, o): o if len(measures) == 1 else f"{o}_{m}" for m in measures for o in options}
    return wide.select(*keys, *[F.col(f"`{source}`").alias(f"{m}_{o}") for (m, o), source in names.items()])


def storm_summary_report(summary: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    chosen = summary.join(event_labels(events), "event_id", "left").select(
        "airport_code", "storm", "event_id", "storm_onset", "sustained_onset", "precip_end",
        "winter_precip_hours", "freezing_rain_hours", "ice_pellets_hours", "snow_hours", "min_temp_c",
        "lag_from_sustained_h", "recovery_h", "pre_onset_cancel_rate", "disruption_cancel_rate",
        "weather_reason_share")
    return in_category_order(chosen, "airport_code", params.airports)


def binned_rates(timeline: DataFrame, params: Params) -> DataFrame:
    """Cancellation percentage per bin of the onset axis; sparse bins stay, without a rate."""
    sums = timeline.groupBy(*PAIR, F.col("hours_from_onset_3h").alias("bin_start")).agg(
        F.sum("scheduled_departures").alias("scheduled"), F.sum("cancelled").alias("cancelled"))
    percent = 100 * F.col("cancelled") / F.col("scheduled")
    return sums.select(
        "*",
        values.if_enough(F.col("scheduled"), params.busy_departures, percent).alias("rate_pct"),
        (F.col("bin_start") + params.bin_h / 2).alias("bin_mid"))


def shaded_hours(timeline: DataFrame, airport: str) -> DataFrame:
    """Hours of one station on the onset axis: temperature, and whether the hour is shaded as winter."""
    return timeline.where(F.col("airport_code") == airport).select(
        "event_id", "hours_from_onset", "temp_c",
        F.coalesce("has_winter_precip", F.lit(False)).alias("is_winter_hour"),
    ).orderBy("event_id", "hours_from_onset")


def rates_by_weather(flights: DataFrame) -> DataFrame:
    """Departures and share of cancellations per event and weather group."""
    return flights.where("weather_group is not null").groupBy("event_id", "weather_group").agg(
        F.count("*").alias("departures"), F.avg(F.col("is_cancelled").cast("int")).alias("cancellation_rate"))


def rates_by_weather_pivot(flights: DataFrame, event_ids: Sequence[str]) -> DataFrame:
    wide = flatten_pivot(rates_by_weather(flights), ["weather_group"], "event_id", event_ids,
                         ["departures", "cancellation_rate"])
    return all_categories(wide, "weather_group", fixed.WEATHER_GROUPS)


def busy_winter_hours(airport_hours: DataFrame, params: Params) -> DataFrame:
    winter = airport_hours.where(
        F.col("has_winter_precip") & (F.col("scheduled_departures") >= params.busy_departures))
    running = F.col("scheduled_departures") > F.col("cancelled")
    counted = winter.groupBy(*PAIR).agg(
        F.count("*").alias("busy_winter_hours"), values.count_where(running).alias("winter_hours_with_departures"))
    share = values.ratio(F.col("winter_hours_with_departures"), F.col("busy_winter_hours"))
    return counted.withColumn("share_hours_with_departures", share)


def operations_in_winter(histogram: DataFrame, airport_hours: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Operated departures in winter and normal hours per event and station, and how many busy winter
    hours kept departures going. The `chart_` columns are blank below the minimum of busy winter hours."""
    wide = marts.condition_medians(histogram.where("event_id is not null"), PAIR)
    joined = wide.join(busy_winter_hours(airport_hours, params), PAIR, "left").join(event_labels(events), "event_id", "left")
    taxi = F.col("median_taxi_out_winter") - F.col("median_taxi_out_normal")
    delay = F.col("median_delay_winter") - F.col("median_delay_normal")
    hours = F.col("busy_winter_hours")
    minimum = params.min_busy_winter_hours
    report = joined.select(
        "airport_code", "storm", "event_id",
        F.col("operated_winter").alias("operated_departures_winter"),
        F.col("operated_normal").alias("operated_departures_normal"),
        F.col("median_taxi_out_normal").alias("median_taxi_out_min_normal"),
        F.col("median_taxi_out_winter").alias("median_taxi_out_min_winter"),
        F.col("median_delay_normal").alias("median_dep_delay_min_normal"),
        F.col("median_delay_winter").alias("median_dep_delay_min_winter"),
        taxi.alias("extra_taxi_out_min"),
        delay.alias("extra_dep_delay_min"),
        "busy_winter_hours", "winter_hours_with_departures", "share_hours_with_departures",
        values.if_enough(hours, minimum, taxi).alias("chart_extra_taxi_out_min"),
        values.if_enough(hours, minimum, 100 * F.col("share_hours_with_departures")).alias("chart_share_pct"),
    )
    return in_category_order(report, "airport_code", params.airports)


def cancellation_rates(flights: DataFrame, keys: Sequence[str], params: Params) -> DataFrame:
    """Counts and rates before and during the precipitation per key; works on `onset_flights`."""
    before, cancelled = F.col("is_before"), F.col("is_cancelled")
    counts = flights.groupBy(*keys).agg(
        F.count("*").alias("departures"),
        values.count_where(before).alias("departures_before"),
        values.count_where(~before).alias("departures_during"),
        values.count_where(cancelled).alias("cancelled"),
        values.count_where(cancelled & before).alias("cancelled_before"),
        values.count_where(cancelled & ~before).alias("cancelled_during"),
        values.count_where(cancelled & (F.col("cancellation_code") == "B")).alias("cancelled_weather"),
    )

    def shown(part: str, whole: str, minimum: int) -> Column:
        return values.if_enough(F.col(whole), minimum, values.ratio(F.col(part), F.col(whole)))

    return counts.select(
        "*",
        shown("cancelled_before", "departures_before", params.min_group_departures).alias("cancel_rate_before"),
        shown("cancelled_during", "departures_during", params.min_group_departures).alias("cancel_rate_during"),
        shown("cancelled_weather", "cancelled", params.min_group_cancelled).alias("weather_reason_share"),
    )


def airline_rates(onset_flights: DataFrame, params: Params) -> DataFrame:
    return cancellation_rates(onset_flights, ["airport_code", "airline_group", "event_id"], params)


def airline_rates_report(rates: DataFrame, event_ids: Sequence[str], params: Params) -> DataFrame:
    """Groups with enough departures during at least one storm, storms side by side."""
    best = F.max("departures_during").over(W.partitionBy("airport_code", "airline_group"))
    kept = rates.withColumn("_best", best).where(F.col("_best") >= params.min_group_departures)
    wide = flatten_pivot(kept, ["airport_code", "airline_group"], "event_id", event_ids,
                         ["departures_during", "cancel_rate_before", "cancel_rate_during"])
    return wide.orderBy(position("airport_code", params.airports), "airline_group")


def groups_by_departures(rates: DataFrame, airport: str, params: Params) -> DataFrame:
    """Airline groups of a station with enough departures during a storm, with their total departures."""
    enough = rates.where((F.col("airport_code") == airport)
                         & (F.col("departures_during") >= params.min_group_departures))
    totals = enough.groupBy("airline_group").agg(F.sum("departures").alias("group_departures"))
    return totals.orderBy(F.desc("group_departures"), "airline_group")


def airline_delay_report(histogram: DataFrame, rates: DataFrame, events: DataFrame, airport: str, params: Params) -> DataFrame:
    """Extra delay and taxi-out per airline group and event at one station, biggest group first."""
    at_station = histogram.where((F.col("airport_code") == airport) & F.col("event_id").isNotNull()).drop("airport_code")
    wide = marts.condition_medians(at_station, ["airline_group", "event_id"])
    groups = groups_by_departures(rates, airport, params)
    joined = wide.join(groups, "airline_group").join(event_labels(events), "event_id", "left")
    winter = F.col("operated_winter")

    def extra(measure: str) -> Column:
        difference = F.col(f"median_{measure}_winter") - F.col(f"median_{measure}_normal")
        return values.if_enough(winter, params.min_group_operated, difference)

    return joined.select(
        "airline_group", "storm", "event_id", "group_departures", "operated_normal", "operated_winter",
        "median_delay_normal", "median_delay_winter", "median_taxi_out_normal", "median_taxi_out_winter",
        extra("delay").alias("extra_delay_min"), extra("taxi_out").alias("extra_taxi_out_min"),
    ).orderBy(F.desc("group_departures"), "airline_group", F.desc("event_id"))


def day_rates(airport_hours: DataFrame, storms: DataFrame, params: Params) -> DataFrame:
    """Days with cancellation and delay rates and the baseline of the event's normal days: medians, and
    a delay threshold from the median absolute deviation. Groups hold the days of one data window."""
    kinds = F.array_sort(F.collect_set(F.when(F.col("weather_group") != "none", F.col("weather_group"))))
    days = airport_hours.groupBy(*PAIR, F.to_date("weather_hour").alias("day")).agg(
        *[F.sum(source).alias(name) for name, source in {
            "departures": "scheduled_departures", "cancelled": "cancelled", "cancelled_weather": "cancelled_weather",
            "cancelled_carrier": "cancelled_carrier", "cancelled_nas": "cancelled_nas", "delayed_15": "delayed_15",
        }.items()],
        F.coalesce(F.bool_or("has_winter_precip"), F.lit(False)).alias("had_winter_precip"),
        F.min("temp_c").alias("min_temp_c"),
        F.nullif(F.array_join(kinds, ", "), F.lit("")).alias("weather"),
    )
    operated = F.col("departures") - F.col("cancelled")
    rated = days.join(storms, PAIR, "left").withColumns({
        "in_storm": values.within(F.col("day"), F.col("storm_first_day"), F.col("storm_last_day")),
        "operated": operated,
        "cancel_rate": values.ratio(F.col("cancelled"), F.col("departures")),
        "delay_rate": values.if_enough(operated, 1, values.ratio(F.col("delayed_15"), operated)),
    })
    enough = F.col("departures") >= params.min_day_departures
    normal = ~F.col("in_storm") & ~F.col("had_winter_precip") & enough
    with_medians = rated.withColumns({
        "normal_cancel_rate": marts.baseline(F.col("cancel_rate"), normal),
        "normal_delay_rate": marts.baseline(F.col("delay_rate"), normal),
    })
    deviation = F.abs(F.col("delay_rate") - F.col("normal_delay_rate"))
    spread = with_medians.withColumn("delay_mad", marts.baseline(deviation, normal))
    threshold = F.col("normal_delay_rate") + params.mad_multiple * params.mad_scale * F.col("delay_mad")
    return spread.withColumn("delay_threshold", threshold)


def flagged_days(days: DataFrame, params: Params) -> DataFrame:
    return days.where(marts.is_unusual(F.col("cancel_rate"), params))


def is_delay_only(params: Params) -> Column:
    """A day outside the storm with many delays but few cancellations."""
    return (
        (F.col("departures") >= params.min_day_departures) & ~F.col("in_storm")
        & (F.col("cancel_rate") < params.unusual_rate) & (F.col("delay_rate") >= F.col("delay_threshold")))


def delay_mad_threshold(days: DataFrame, params: Params) -> DataFrame:
    """Baseline per event and station with the number of delay-only days."""
    found = ["normal_cancel_rate", "normal_delay_rate", "delay_mad", "delay_threshold"]
    return days.where("delay_threshold is not null").groupBy(*PAIR, *found).agg(
        values.count_where(is_delay_only(params)).alias("delay_only_days"))


def day_text() -> Column:
    return F.date_format("day", "EEE dd MMM yyyy")


def unusual_day_report(days: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Flagged days with their baseline, reason and weather."""
    labelled = flagged_days(days, params).join(event_labels(events), "event_id", "left")
    return labelled.select(
        "storm", "event_id", "airport_code", "day", day_text().alias("date"), "departures", "cancel_rate",
        "normal_cancel_rate", "delay_rate", "normal_delay_rate", marts.main_reason(params).alias("main_cancel_reason"),
        "weather", "min_temp_c",
    ).orderBy(F.desc("event_id"), "day", "airport_code")


def unusual_day_details(days: DataFrame, weather: DataFrame, arrivals: DataFrame, events: DataFrame,
                        params: Params) -> DataFrame:
    """Flagged days with the day's weather, diverted arrivals and the likely explanation."""
    normal = marts.normal_diversions(arrivals)
    diverted = arrivals.withColumn("year", F.year("day")).join(normal, ["airport_code", "year"])
    at_day = ["airport_code", "day"]
    report = unusual_day_report(days, events, params).select(
        "storm", "airport_code", "day", "date", "cancel_rate", "main_cancel_reason")
    details = report.join(weather.drop("min_temp_c"), at_day, "left").join(diverted, at_day, "left")
    return details.select(
        "storm", "airport_code", "day", "date", "cancel_rate", "main_cancel_reason",
        "thunder_hours", "rain_hours", "winter_hours", "max_gust_kmh", "min_visibility_km",
        "arrivals", "diverted_arrivals", "normal_diverted_arrivals",
        marts.explanation("local thunderstorms", "weather elsewhere in the network").alias("explanation"),
    )


def cancelled_but_delayed(flights: DataFrame, params: Params) -> DataFrame:
    cancelled = F.col("is_cancelled")
    late = F.col("dep_delay_min") >= params.delayed_from_min
    return flights.groupBy("event_id").agg(
        values.count_where(cancelled).alias("cancelled"),
        values.count_where(cancelled & late).alias("cancelled_with_delay"))


def implausible_precip(weather: DataFrame, min_mm: float) -> DataFrame:
    """Hours with more precipitation than plausible, the largest first."""
    return weather.where(F.col("precip_mm") >= min_mm).select(
        *["airport_code", "weather_hour", "precip_mm", "weather_codes_hour", "temp_c"]
    ).orderBy(F.desc("precip_mm"), "airport_code", "weather_hour")


def onset_axis(airport_hours: DataFrame, summary: DataFrame) -> DataFrame:
    """All event hours on the onset axis, without the window cut."""
    onset = F.coalesce("sustained_onset", "storm_onset")
    storms = summary.where("storm_onset is not null").select(*PAIR, onset.alias("onset_hour"))
    return airport_hours.join(storms, PAIR).select(
        *PAIR, "weather_hour", "scheduled_departures", "cancelled", "has_winter_precip", "temp_c",
        times.hours_between(F.col("onset_hour"), F.col("weather_hour")).alias("hours_from_onset"))
