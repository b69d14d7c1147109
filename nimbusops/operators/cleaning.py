"""Raw records to typed, named, unit-converted rows. Narrow projections only: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.config import Params
from nimbusops.functions import times, values

# Cleaned name of each flight source column that is only renamed, in output order.
_FLIGHT_NAMES = {
    "flight_date": "FlightDate",
    "airline_code": "Reporting_Airline",
    "flight_number": "Flight_Number_Reporting_Airline",
    "tail_number": "Tail_Number",
    "origin_airport": "Origin",
    "dest_airport": "Dest",
    "scheduled_dep_hhmm": "CRSDepTime",
    "actual_dep_hhmm": "DepTime",
    "wheels_off_hhmm": "WheelsOff",
    "scheduled_arr_hhmm": "CRSArrTime",
    "actual_arr_hhmm": "ArrTime",
    "dep_delay_min": "DepDelay",
    "arr_delay_min": "ArrDelay",
    "taxi_out_min": "TaxiOut",
    "scheduled_elapsed_min": "CRSElapsedTime",
    "actual_elapsed_min": "ActualElapsedTime",
    "air_time_min": "AirTime",
    "carrier_delay_min": "CarrierDelay",
    "weather_delay_min": "WeatherDelay",
    "nas_delay_min": "NASDelay",
    "security_delay_min": "SecurityDelay",
    "late_aircraft_delay_min": "LateAircraftDelay",
}


def clean_flights(raw: DataFrame) -> DataFrame:
    """One row per scheduled flight: names, boolean outcome, decoded reason, kilometres, key."""
    return raw.select(
        values.surrogate_key(
            "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin"
        ).alias("flight_id"),
        *[F.col(source).alias(name) for name, source in _FLIGHT_NAMES.items()],
        (F.col("Cancelled") == 1).alias("is_cancelled"),
        (F.col("Diverted") == 1).alias("is_diverted"),
        F.col("CancellationCode").alias("cancellation_code"),
        values.decode(F.col("CancellationCode"), fixed.CANCELLATION_REASONS).alias("cancellation_reason"),
        F.col("Distance").alias("distance_miles"),
        values.scaled(F.col("Distance"), fixed.KM_PER_MILE, 1).alias("distance_km"),
        "_source_file",
    )


def clean_observations(raw: DataFrame, zone: str) -> DataFrame:
    """One row per report: numbers from text, metric units, local time, key."""
    def number(field: str, trace: float | None = None):
        return values.sentinel_number(F.col(field), trace)

    return raw.select(
        values.surrogate_key("airport_code", "valid_utc", "report_type").alias("metar_id"),
        "airport_code",
        "report_type",
        "valid_utc",
        times.utc_to_local(zone, F.col("valid_utc")).alias("valid_local"),
        values.fahrenheit_to_celsius(number("tmpf")).alias("temp_c"),
        values.fahrenheit_to_celsius(number("dwpf")).alias("dewpoint_c"),
        number("relh").alias("rel_humidity_pct"),
        number("drct").alias("wind_dir_deg"),
        values.scaled(number("sknt"), fixed.KMH_PER_KNOT, 1).alias("wind_speed_kmh"),
        values.scaled(number("gust"), fixed.KMH_PER_KNOT, 1).alias("wind_gust_kmh"),
        values.scaled(number("vsby"), fixed.KM_PER_MILE, 2).alias("visibility_km"),
        F.nullif(F.col("skyc1"), F.lit("M")).alias("sky_cover_lowest"),
        values.scaled(number("skyl1"), fixed.M_PER_FOOT).alias("cloud_base_lowest_m"),
        values.scaled(number("p01i", trace=0), fixed.MM_PER_INCH, 2).alias("precip_mm"),
        (F.col("p01i") == "T").alias("is_precip_trace"),
        values.scaled(number("ice_accretion_1hr", trace=0), fixed.MM_PER_INCH, 2).alias("ice_accretion_1h_mm"),
        (F.col("ice_accretion_1hr") == "T").alias("is_ice_accretion_trace"),
        F.nullif(F.col("wxcodes"), F.lit("M")).alias("weather_codes"),
        F.col("metar").alias("raw_metar"),
    )


def time_flights(flights: DataFrame, params: Params) -> DataFrame:
    """Flights with local timestamps and the departure hour that weather is matched on.

    The actual departure is the schedule plus the delay, for operated flights only. The arrival is
    filled at the given airports and moves to the next day when its clock time is more than
    `arrival_rollover_h` before the departure.
    """
    airports = list(params.airports)
    departure, arrival = F.col("scheduled_dep_ts"), F.col("_arrival")
    operated, delay = ~F.col("is_cancelled"), F.col("dep_delay_min")
    next_day = arrival < departure - times.hours(params.arrival_rollover_h)
    timed = flights.select(
        "*",
        times.at_minute(F.col("flight_date"), times.hhmm_minutes(F.col("scheduled_dep_hhmm"))).alias("scheduled_dep_ts"),
        times.at_minute(F.col("flight_date"), times.hhmm_minutes(F.col("scheduled_arr_hhmm"))).alias("_arrival"),
    )
    return timed.select(
        "flight_id", "flight_date", "airline_code", "flight_number", "tail_number",
        "origin_airport", "dest_airport",
        F.col("origin_airport").isin(airports).alias("is_departure"),
        F.col("dest_airport").isin(airports).alias("is_arrival"),
        "scheduled_dep_ts",
        times.trunc("hour", departure).alias("scheduled_dep_hour"),
        F.when(operated & delay.isNotNull(),
               departure + F.make_dt_interval(mins=values.rounded(delay, 0).cast("int"))).alias("actual_dep_ts"),
        F.when(F.col("dest_airport").isin(airports),
               arrival + F.make_dt_interval(days=next_day.cast("int"))).alias("scheduled_arr_ts"),
        "is_cancelled", "cancellation_code", "cancellation_reason", "is_diverted",
        "dep_delay_min", "arr_delay_min",
        (operated & (delay >= params.delayed_from_min)).alias("is_dep_delayed_15"),
        "taxi_out_min", "carrier_delay_min", "weather_delay_min", "nas_delay_min",
        "security_delay_min", "late_aircraft_delay_min", "distance_km",
    )
