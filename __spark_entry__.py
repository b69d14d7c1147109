"""

Each query builds its own chain from the given tables, so its time includes everything from the raw
rows on; nothing is shared between queries.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbusops import adapters
from nimbusops import fixed_values as fixed
from nimbusops.config import Station, events_frame, events_from_seed, select_events, stations_frame
from nimbusops.functions import times, values
from nimbusops.operators import episodes, hourly, medians
from nimbusops.plans import build, marts, reports
from nimbusops.plans.warehouse import LAYERS, PARENTS, Warehouse
from nimbusops.quality import checks
from nimbusops.quality.oracle import ACROSS, all_checks, count_of, statement
from nimbusops.session import Staging, prepare, scoped
from nimbusops.sources import landing, planning, readers, schemas, writers

try:  # the corpus operators and their pipeline are an optional part
    import corpus_pipeline
    from nimbusops.llm import queries as corpus
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "nimbusops.llm"):  # they are here, and something they need is not
        raise
    corpus_pipeline = corpus = None

Query = Callable[[SparkSession, str], DataFrame]

PARAMS = adapters.PARAMS
PAIR = list(episodes.PAIR)
IDS = [e.event_id for e in adapters.EVENTS]
HOME = adapters.AIRPORTS[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    events = read(spark, sf_dir, "events")
    return Warehouse(spark, lambda: adapters.raw_flights(events), lambda: adapters.raw_observations(events),
                     adapters.EVENTS, PARAMS)


_registry: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None):
    """Register a query. Tables that it stages on its way are gone when its result is there."""
    def register(function: Query) -> Query:
        _registry[function.__name__] = (lambda spark, sf: scoped(prepare(spark), lambda: function(spark, sf)), sql)
        return function

    return register


def model(name: str, sql: str) -> None:
    """Register a warehouse model as a query. Models of raw grain are not written, they stay plans over the staged
    tables that they need."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = lambda: warehouse(spark, sf_dir).view(name)
        return plan() if name == "flights_weather" else scoped(prepare(spark), plan)

    _registry[name] = (run, sql)


# --- cleaning and scalar functions -----------------------------------------------------------------

@query("""SELECT flight_id, d AS flight_date, carrier AS airline_code, k AS flight_number,
    org AS origin_airport, dst AS dest_airport, dep_delay_min, taxi_out_min, is_cancelled, is_diverted,
    cancellation_code, reason AS cancellation_reason, CAST(100 + k % 1900 AS DOUBLE) AS distance_miles,
    round((100 + k % 1900) * CAST(1.609344 AS DOUBLE), 1) AS distance_km FROM flt""")
def typed_projection(spark, sf_dir):
    return warehouse(spark, sf_dir).view("flights_clean").select(
        "flight_id", "flight_date", "airline_code", "flight_number", "origin_airport", "dest_airport", "dep_delay_min",
        "taxi_out_min", "is_cancelled", "is_diverted", "cancellation_code", "cancellation_reason", "distance_miles",
        "distance_km")


@query("""SELECT metar_id, airport_code, if(is_special, 'special', 'routine') AS report_type, valid_local, temp_c, dewpoint_c,
    rel_humidity_pct, wind_dir_deg, wind_speed_kmh, wind_gust_kmh, visibility_km, sky_cover_lowest, cloud_base_lowest_m,
    precip_mm, is_precip_trace, ice_accretion_1h_mm, is_ice_accretion_trace, codes AS weather_codes FROM obs""")
def sentinel_numbers(spark, sf_dir):
    return warehouse(spark, sf_dir).view("observations").drop("valid_utc", "raw_metar")


@query("""SELECT metar_id, codes_text, has_freezing_rain, has_ice_pellets, has_snow, has_rain, has_fog, has_thunder FROM flagged""")
def code_flags(spark, sf_dir):
    reports_ = hourly.parse_weather_codes(warehouse(spark, sf_dir).view("observations"))
    return reports_.select("metar_id", "codes_text", *fixed.PHENOMENA)


@query("""SELECT flight_id, true AS is_departure, dst <> 'ZZZ' AS is_arrival, sched AS scheduled_dep_ts, dep_hour AS scheduled_dep_hour,
    CASE WHEN NOT is_cancelled THEN sched + to_minutes(CAST(dep_delay_min AS INTEGER)) END AS actual_dep_ts, scheduled_arr_ts,
    is_cancelled, dep_delay_min, CAST(k % 45 - 10 AS DOUBLE) AS arr_delay_min, late AS is_dep_delayed_15 FROM arr""")
def hhmm_timestamps(spark, sf_dir):
    return warehouse(spark, sf_dir).view("flights").select(
        "flight_id", "is_departure", "is_arrival", "scheduled_dep_ts", "scheduled_dep_hour", "actual_dep_ts",
        "scheduled_arr_ts", "is_cancelled", "dep_delay_min", "arr_delay_min", "is_dep_delayed_15")


@query("""SELECT o_orderkey, utc AS valid_utc, timezone('America/Chicago', utc AT TIME ZONE 'UTC') AS valid_local,
    CAST(year(timezone('America/Chicago', utc AT TIME ZONE 'UTC')) AS INTEGER) AS year,
    CAST(month(timezone('America/Chicago', utc AT TIME ZONE 'UTC')) AS INTEGER) AS month
    FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS utc FROM orders)""")
def utc_to_local_month(spark, sf_dir):
    """Order times as UTC text in the source format: parsed, converted and cut to the local month."""
    minute = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    text = F.date_format(minute, "yyyy-MM-dd HH:mm")
    utc = F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm"))
    local = times.utc_to_local("America/Chicago", F.col("valid_utc"))
    return read(spark, sf_dir, "orders").select("o_orderkey", utc.alias("valid_utc")).withColumn(
        "valid_local", local).withColumns({"year": F.year("valid_local"), "month": F.month("valid_local")})


@query("""SELECT o_orderkey, md5(concat_ws('|', o_orderkey, CAST(o_orderdate AS DATE), o_orderpriority)) AS order_key,
    o_orderstatus || '_' || CAST(o_custkey AS VARCHAR) AS joined_key FROM orders""")
def surrogate_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", values.surrogate_key("o_orderkey", F.to_date("o_orderdate"), "o_orderpriority").alias("order_key"),
        F.concat("o_orderstatus", F.lit("_"), F.col("o_custkey").cast("string")).alias("joined_key"))


# --- hourly tables ---------------------------------------------------------------------------------

@query("SELECT metar_id, valid_local, weather_hour FROM flagged")
def hour_shift(spark, sf_dir):
    return hourly.assign_hour(warehouse(spark, sf_dir).view("observations"), PARAMS.hour_shift_min).select(
        "metar_id", "valid_local", "weather_hour")


model("hourly_observations", "SELECT * FROM obs_hour")
model("hour_grid", "SELECT * FROM grid")
model("weather_hourly", "SELECT * FROM weather")
model("hourly_departures", "SELECT * FROM dep")
model("airport_hourly", "SELECT * FROM hrs")
model("flights_weather", "SELECT * FROM fw")


# --- episodes --------------------------------------------------------------------------------------

def searched(wh: Warehouse) -> DataFrame:
    return episodes.search_window(wh.view("airport_hourly").where("event_id is not null"), wh.events, PARAMS)


def bounded(wh: Warehouse) -> DataFrame:
    wh.table("airport_hourly")
    return episodes.with_bounds(searched(wh), episodes.storm_bounds(searched(wh), PARAMS))


@query("SELECT event_id, airport_code, weather_hour FROM searched")
def search_window(spark, sf_dir):
    return searched(warehouse(spark, sf_dir)).where("in_search").select(*PAIR, "weather_hour")


@query("SELECT event_id, airport_code, weather_hour, episode_number FROM numbered")
def gap_sessions(spark, sf_dir):
    return episodes.winter_hours(searched(warehouse(spark, sf_dir)), PARAMS).drop("run_number")


@query("SELECT event_id, airport_code, storm_onset, precip_end, n_winter_episodes FROM main")
def main_session(spark, sf_dir):
    return episodes.storm_bounds(searched(warehouse(spark, sf_dir)), PARAMS).drop("sustained_onset")


@query("SELECT * FROM runs")
def consecutive_runs(spark, sf_dir):
    return episodes.run_sizes(episodes.winter_hours(searched(warehouse(spark, sf_dir)), PARAMS))


@query("SELECT event_id, airport_code, sustained_onset FROM main WHERE sustained_onset IS NOT NULL")
def sustained_onset(spark, sf_dir):
    bounds = episodes.storm_bounds(searched(warehouse(spark, sf_dir)), PARAMS)
    return bounds.select(*PAIR, "sustained_onset").where("sustained_onset is not null")


@query("SELECT * FROM mass")
def mass_onset(spark, sf_dir):
    hours = bounded(warehouse(spark, sf_dir)).groupBy(*PAIR)
    return hours.agg(episodes.first_mass_hour(PARAMS).alias("first_mass_cancel_hour")).where(
        "first_mass_cancel_hour is not null")


@query("SELECT * FROM recov")
def stable_recovery(spark, sf_dir):
    hours = episodes.with_recovery(bounded(warehouse(spark, sf_dir)), PARAMS)
    return hours.where("recovery_hour is not null").groupBy(*PAIR).agg(F.min("recovery_hour").alias("recovery_hour"))


@query("SELECT * FROM totals")
def window_totals(spark, sf_dir):
    hours = episodes.with_recovery(bounded(warehouse(spark, sf_dir)), PARAMS).where("storm_onset is not null")
    return hours.groupBy(*PAIR).agg(*episodes.window_totals(PARAMS))


# --- marts -----------------------------------------------------------------------------------------

model("storm_summary", "SELECT * FROM summ")
model("storm_timeline", "SELECT * FROM tl")
model("airline_windows", "SELECT * FROM aw")
model("winter_normal_medians", "SELECT * FROM med")
model("airline_storm", "SELECT * FROM air")
model("daily_departures", "SELECT * FROM dday")
model("daily_weather", "SELECT * FROM wday")
model("daily_arrivals", "SELECT * FROM aday")
model("storm_days", "SELECT * FROM sday")
model("airport_daily", "SELECT * FROM daily")
model("unusual_days", "SELECT * FROM unus")


# --- reports ---------------------------------------------------------------------------------------

@query("""SELECT airport_code, label AS storm, event_id, storm_onset, sustained_onset, precip_end, winter_precip_hours,
    freezing_rain_hours, ice_pellets_hours, snow_hours, min_temp_c, lag_from_sustained_h, recovery_h, pre_onset_cancel_rate,
    disruption_cancel_rate, weather_reason_share FROM summ JOIN ev USING (event_id)""")
def summary_report(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    return reports.storm_summary_report(wh.view("storm_summary"), wh.events, PARAMS)


@query("""SELECT event_id, airport_code, weather_hour, scheduled_departures, cancelled, has_winter_precip, temp_c, hours_from_onset
    FROM axis""")
def onset_axis(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    return reports.onset_axis(wh.table("airport_hourly"), wh.table("storm_summary"))


@query("""SELECT event_id, airport_code, hours_from_onset_3h AS bin_start, CAST(sum(scheduled_departures) AS BIGINT) AS scheduled,
    CAST(sum(cancelled) AS BIGINT) AS cancelled,
    if(sum(scheduled_departures) > 2, 100 * sum(cancelled) / sum(scheduled_departures), NULL) AS rate_pct,
    hours_from_onset_3h + CAST(1.5 AS DOUBLE) AS bin_mid FROM tl GROUP BY 1, 2, 3""")
def binned_rates(spark, sf_dir):
    return reports.binned_rates(warehouse(spark, sf_dir).view("storm_timeline"), PARAMS)


@query("""SELECT event_id, hours_from_onset, temp_c, ifnull(has_winter_precip, false) AS is_winter_hour
    FROM tl WHERE airport_code = 'AAA'""")
def shaded_hours(spark, sf_dir):
    return reports.shaded_hours(warehouse(spark, sf_dir).view("storm_timeline"), HOME)


@query("""SELECT event_id, weather_group, count(*) AS departures, count(*) FILTER (is_cancelled) / count(*) AS cancellation_rate
    FROM fw WHERE weather_group IS NOT NULL GROUP BY 1, 2""")
def rates_by_weather(spark, sf_dir):
    return reports.rates_by_weather(warehouse(spark, sf_dir).view("flights_weather"))


@query("""SELECT g.weather_group, nullif(count(*) FILTER (event_id = 'ev_a'), 0) AS departures_ev_a,
    nullif(count(*) FILTER (event_id = 'ev_b'), 0) AS departures_ev_b,
    avg(CAST(is_cancelled AS INTEGER)) FILTER (event_id = 'ev_a') AS cancellation_rate_ev_a,
    avg(CAST(is_cancelled AS INTEGER)) FILTER (event_id = 'ev_b') AS cancellation_rate_ev_b
    FROM (SELECT unnest(['freezing_rain', 'ice_pellets', 'snow', 'rain', 'fog', 'none']) AS weather_group) g
    LEFT JOIN fw USING (weather_group) GROUP BY 1""")
def rates_by_weather_pivot(spark, sf_dir):
    return reports.rates_by_weather_pivot(warehouse(spark, sf_dir).view("flights_weather"), IDS)


@query("""SELECT airport_code, label AS storm, event_id, nullif(n_w, 0) AS operated_departures_winter, nullif(n_n, 0) AS operated_departures_normal,
    t_n AS median_taxi_out_min_normal, t_w AS median_taxi_out_min_winter, d_n AS median_dep_delay_min_normal,
    d_w AS median_dep_delay_min_winter, t_w - t_n AS extra_taxi_out_min, d_w - d_n AS extra_dep_delay_min,
    busy AS busy_winter_hours, running AS winter_hours_with_departures, running / busy AS share_hours_with_departures,
    if(busy >= 10, t_w - t_n, NULL) AS chart_extra_taxi_out_min, if(busy >= 10, 100 * (running / busy), NULL) AS chart_share_pct
    FROM wide JOIN ev USING (event_id) LEFT JOIN bwh USING (event_id, airport_code)""")
def operations_in_winter(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    wh.table("weather_hourly")
    return reports.operations_in_winter(wh.view("station_histogram"), wh.view("airport_hourly"), wh.events, PARAMS)


@query("SELECT * FROM rates")
def airline_rates(spark, sf_dir):
    return reports.airline_rates(warehouse(spark, sf_dir).view("onset_flights"), PARAMS)


@query("""SELECT airport_code, airline_group, """ + ", ".join(
    f"max(if(event_id = '{e}', {m}, NULL)) AS {m}_{e}"
    for m in ("departures_during", "cancel_rate_before", "cancel_rate_during") for e in ("ev_a", "ev_b")) + """
    FROM rates GROUP BY 1, 2 HAVING max(departures_during) >= 30""")
def airline_rates_report(spark, sf_dir):
    rates = reports.airline_rates(warehouse(spark, sf_dir).view("onset_flights"), PARAMS)
    return reports.airline_rates_report(rates, IDS, PARAMS)


@query("""SELECT airline_group, label AS storm, event_id, group_departures, nullif(count(*) FILTER (NOT w), 0) AS operated_normal,
    nullif(count(*) FILTER (w), 0) AS operated_winter,
    median(dep_delay_min) FILTER (NOT w) AS median_delay_normal, median(dep_delay_min) FILTER (w) AS median_delay_winter,
    median(taxi_out_min) FILTER (NOT w) AS median_taxi_out_normal, median(taxi_out_min) FILTER (w) AS median_taxi_out_winter,
    if(count(*) FILTER (w) >= 20, median(dep_delay_min) FILTER (w) - median(dep_delay_min) FILTER (NOT w), NULL) AS extra_delay_min,
    if(count(*) FILTER (w) >= 20, median(taxi_out_min) FILTER (w) - median(taxi_out_min) FILTER (NOT w), NULL) AS extra_taxi_out_min
    FROM op JOIN ev USING (event_id) JOIN (
        SELECT airline_group, CAST(sum(departures) AS BIGINT) AS group_departures FROM rates
        WHERE airport_code = 'AAA' AND departures_during >= 30 GROUP BY 1) t USING (airline_group)
    WHERE airport_code = 'AAA' GROUP BY 1, 2, 3, 4""")
def airline_delay_report(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    wh.table("weather_hourly")
    rates = reports.airline_rates(wh.view("onset_flights"), PARAMS)
    return reports.airline_delay_report(wh.view("group_histogram"), rates, wh.events, HOME, PARAMS)


@query("""SELECT l_returnflag, count(*) AS lines, round(median(l_extendedprice), 6) AS median_price,
    round(median(l_extendedprice * (1 - l_discount)), 6) AS median_paid FROM lineitem GROUP BY 1""")
def continuous_medians(spark, sf_dir):
    """Medians of prices, which hardly repeat, by refinement to a thousand values."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("paid"))
    found = medians.histogram_medians(medians.value_histogram(lines, ["l_returnflag"], ["price", "paid"]), ["l_returnflag"], ["price", "paid"], 1000, 256)
    return found.select("l_returnflag", F.col("rows").alias("lines"), F.round("median_price", 6).alias("median_price"), F.round("median_paid", 6).alias("median_paid"))


def day_rates(wh: Warehouse) -> DataFrame:
    return reports.day_rates(
        wh.table("airport_hourly").where("event_id is not null"), wh.view("storm_days"), PARAMS)


@query("""SELECT event_id, airport_code, normal_cancel_rate, normal_delay_rate, delay_mad, delay_threshold,
    (SELECT count(*) FROM drate d WHERE d.event_id = b.event_id AND d.airport_code = b.airport_code AND NOT in_storm
     AND departures > 19 AND rate < 0.05 AND delay_rate >= delay_threshold) AS delay_only_days FROM base b""")
def delay_mad_threshold(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    return reports.delay_mad_threshold(day_rates(wh), PARAMS)


@query("""SELECT label AS storm, event_id, f.airport_code, f.day, strftime(f.day, '%a %d %b %Y') AS date, departures, rate AS cancel_rate,
    normal_cancel_rate, delay_rate, normal_delay_rate, reason AS main_cancel_reason, weather, min_temp_c
    FROM flagday f JOIN ev USING (event_id) LEFT JOIN base USING (event_id, airport_code)
    LEFT JOIN kinds USING (event_id, airport_code, day)""")
def unusual_day_report(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    return reports.unusual_day_report(day_rates(wh), wh.events, PARAMS)


@query("""SELECT label AS storm, f.airport_code, day, strftime(day, '%a %d %b %Y') AS date, rate AS cancel_rate, reason AS main_cancel_reason,
    thunder_hours, rain_hours, winter_hours, max_gust_kmh, min_visibility_km, nullif(arrivals, 0) AS arrivals,
    if(arrivals = 0, NULL, diverted_arrivals) AS diverted_arrivals, normal_diverted_arrivals,
    if(winter_hours > 0, 'local snow or ice',
       if(thunder_hours > 0, 'local thunderstorms', 'weather elsewhere in the network')) AS explanation
    FROM flagday f JOIN ev USING (event_id) LEFT JOIN ndiv n ON n.airport_code = f.airport_code AND n.y = year(day)""")
def unusual_day_details(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    wh.table("weather_hourly")
    return reports.unusual_day_details(
        day_rates(wh), wh.view("daily_weather"), wh.table("daily_arrivals"), wh.events, PARAMS)


@query("""SELECT event_id, count(*) FILTER (is_cancelled) AS cancelled,
    count(*) FILTER (is_cancelled AND dep_delay_min >= 15) AS cancelled_with_delay FROM fw GROUP BY 1""")
def cancelled_but_delayed(spark, sf_dir):
    return reports.cancelled_but_delayed(warehouse(spark, sf_dir).view("departures"), PARAMS)


@query("""SELECT airport_code, weather_hour, precip_mm, weather_codes_hour, temp_c FROM weather WHERE precip_mm >= 12""")
def implausible_values(spark, sf_dir):
    return reports.implausible_precip(warehouse(spark, sf_dir).view("weather_hourly"), PARAMS.implausible_precip_mm)


@query("""SELECT event_id, count(*) AS pairs, max(recovery_h) AS longest_recovery_h, CAST(sum(winter_precip_hours) AS BIGINT) AS winter_hours
    FROM summ GROUP BY 1""")
def sql_over_marts(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    (name,) = wh.register(["storm_summary"], prefix=f"run_{uuid.uuid4().hex}_")
    result = wh.query("SELECT event_id, count(*) AS pairs, max(recovery_h) AS longest_recovery_h, "
                      f"sum(winter_precip_hours) AS winter_hours FROM {name} GROUP BY event_id")
    wh.unregister()
    return result


# --- sources and sinks -----------------------------------------------------------------------------

@query("""SELECT y AS year, m AS month, count(*) AS customers FROM (
    SELECT o_custkey, CAST(year(h) AS INTEGER) AS y, CAST(month(h) AS INTEGER) AS m FROM (
        SELECT o_custkey, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS h
        FROM orders GROUP BY 1)) GROUP BY 1, 2""")
def month_plan(spark, sf_dir):
    """Months that each customer's order window touches, counted per month."""
    windows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    plan = planning.month_plan(windows, ["o_custkey"], "first", "last")
    return plan.groupBy("year", "month").agg(F.count("*").alias("customers"))


@query("""SELECT problem, count(*) AS windows FROM (
    SELECT CASE WHEN min(l_shipdate) < any_value(o_orderdate) THEN 'storm starts before the data'
                WHEN max(l_shipdate) > any_value(o_orderdate) + INTERVAL 365 DAY THEN 'storm ends after the data' END AS problem
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) WHERE problem IS NOT NULL GROUP BY 1""")
def validate_windows(spark, sf_dir):
    """Order windows (order date and a year) against their shipping dates."""
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("storm_start"), F.to_date(F.max("l_shipdate")).alias("storm_end"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("data_start"))
    windows = orders.withColumn("data_end", F.date_add("data_start", 365)).join(
        shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return planning.invalid_windows(windows).groupBy("problem").agg(F.count("*").alias("windows"))


@query("""SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, count(*) AS flights, min(d) AS first_date,
    max(d) AS last_date, CAST(count(*) FILTER (is_cancelled) AS INTEGER) AS cancelled,
    count(*) FILTER (cancellation_code IS NOT NULL) AS cancelled_with_code, true AS dates_in_month, 0::BIGINT AS without_code
    FROM flt GROUP BY 1, 2""")
def ingest_summary(spark, sf_dir):
    flights = adapters.raw_flights(read(spark, sf_dir, "events"))
    return planning.flight_batches(flights.withColumns({"year": F.year("FlightDate"), "month": F.month("FlightDate")}))


@query("""SELECT airport_code, CAST(year(l) AS INTEGER) AS year, CAST(month(l) AS INTEGER) AS month,
    count(*) FILTER (NOT is_special) AS routine, count(*) FILTER (is_special) AS special,
    min(f) AS min_tmpf, max(f) AS max_tmpf,
    count(*) FILTER (codes IN ('-FZRA BR', 'SN', 'PL')) AS winter_reports,
    CAST(day(last_day(any_value(l))) * 24 AS INTEGER) AS expected_hours
    FROM (SELECT org AS airport_code, k % 5 = 0 AS is_special, codes, if(k % 11 = 0, NULL, floor(value)) AS f,
          timezone('America/Chicago', ts AT TIME ZONE 'UTC') AS l FROM wx) GROUP BY 1, 2, 3""")
def observation_summary(spark, sf_dir):
    """Raw reports of both types joined to their stations, per local month of the station's zone."""
    raw = adapters.raw_observations(read(spark, sf_dir, "events"))
    text = raw.withColumn("valid", F.date_format("valid_utc", "yyyy-MM-dd HH:mm")).drop("airport_code", "valid_utc")
    both = readers.union_reports(*[text.where(F.col("report_type") == t).drop("report_type")
                                   for t in (fixed.ROUTINE, fixed.SPECIAL)])
    stations = stations_frame(spark, [Station(a, a, a, a, "America/Chicago") for a in adapters.AIRPORTS])
    return planning.observation_batches(readers.station_observations(both, stations))


@query("""SELECT org AS airport_code, if(k % 5 = 0, 'special', 'routine') AS report_type, count(*) AS reports,
    min(ts) AS first_report, max(ts) AS last_report FROM wx GROUP BY 1, 2""")
def union_reports(spark, sf_dir):
    raw = adapters.raw_observations(read(spark, sf_dir, "events"))
    both = readers.union_reports(*[raw.where(F.col("report_type") == t).drop("report_type")
                                   for t in (fixed.ROUTINE, fixed.SPECIAL)])
    return both.groupBy("airport_code", "report_type").agg(
        F.count("*").alias("reports"), F.min("valid_utc").alias("first_report"), F.max("valid_utc").alias("last_report"))


@query("""SELECT d AS FlightDate, carrier AS Reporting_Airline, k AS Flight_Number_Reporting_Airline, org AS Origin,
    true AS from_csv, dst AS Dest, if(k % 2 = 0, CAST(CAST(strftime(ts, '%H%M') AS INTEGER) AS VARCHAR), strftime(ts, '%H%M')) AS CRSDepTime,
    dep_delay_min AS DepDelay, CAST(CAST(is_cancelled AS INTEGER) AS DOUBLE) AS Cancelled, cancellation_code AS CancellationCode,
    CAST(100 + k % 1900 AS DOUBLE) AS Distance FROM flt WHERE org IN ('AAA', 'BBB') OR dst IN ('AAA', 'BBB')""")
def csv_roundtrip(spark, sf_dir):
    """Landing: CSV text in, two airports kept, columns cast, sorted monthly Parquet out and read back."""
    raw = adapters.raw_flights(read(spark, sf_dir, "events"))
    folder = Staging(spark).path
    writers.export_csv(raw, f"{folder}/csv")
    writers.write_flights(readers.read_flights_csv(spark, f"{folder}/csv", ("AAA", "BBB")), f"{folder}/flights")
    return readers.read_raw(spark, f"{folder}/flights", schemas.RAW_FLIGHTS).select(
        "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin", "Dest", "CRSDepTime", "DepDelay",
        "Cancelled", "CancellationCode", "Distance", F.col("_source_file").rlike("^part-.*[.]csv$").alias("from_csv"))


@query("""SELECT 'mart_airport_hourly' AS table_name, count(*) AS counted, count(*) AS exported FROM hrs
    UNION ALL SELECT 'mart_storm_summary', count(*), count(*) FROM summ UNION ALL SELECT 'mart_storm_timeline', count(*), count(*) FROM tl""")
def mart_export(spark, sf_dir):
    """CSV files of the tables with a prefix: the count that each export returns, and the rows read back."""
    wh = warehouse(spark, sf_dir)
    prefix, folder = f"run_{uuid.uuid4().hex}_", f"{wh.staging.path}/csv"
    wh.register(["airport_hourly", "storm_summary", "storm_timeline"], prefix)
    exported = writers.export_marts(spark, folder, prefix, single_file=[f"{prefix}mart_storm_summary"])
    wh.unregister()
    counts = [
        spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.count("*").alias("exported"))
        .select(F.lit(name.removeprefix(prefix)).alias("table_name"), F.lit(n).cast("long").alias("counted"), "exported")
        for name, n in exported.items()]
    return reduce(DataFrame.unionByName, counts)


def file_order(path: str, spark: SparkSession, *columns: str) -> DataFrame:
    """Rows of landed files that come before the row in front of them, per file."""
    place = Window.partitionBy("_file").orderBy("_row")
    key = F.struct(*columns)
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.withColumn("out_of_order", F.coalesce(key < F.lag(key).over(place), F.lit(False)))


def stations(zone: str = "America/Chicago") -> list[Station]:
    return [Station(a, a, a, a, zone) for a in adapters.AIRPORTS]


@query("""SELECT org AS airport_code, CAST(year(l) AS INTEGER) AS year, CAST(month(l) AS INTEGER) AS month, count(*) AS reports,
    count(*) FILTER (k % 5 = 0) AS special, min(t) AS first_report, max(t) AS last_report, 0::BIGINT AS out_of_order
    FROM (SELECT *, date_trunc('minute', ts) AS t, timezone('America/Chicago', date_trunc('minute', ts) AT TIME ZONE 'UTC') AS l FROM wx)
    WHERE month(l) = 1 GROUP BY 1, 2, 3""")
def weather_landing(spark, sf_dir):
    """Weather landing: CSV text of two report types in, cut to the planned local months (January), sorted
    airport-month files out; read back with the order of their rows."""
    raw = adapters.raw_observations(read(spark, sf_dir, "events"))
    text = raw.withColumn("valid", F.date_format("valid_utc", "yyyy-MM-dd HH:mm")).drop("airport_code", "valid_utc")
    staging = Staging(spark)
    for kind in (fixed.ROUTINE, fixed.SPECIAL):
        writers.export_csv(text.where(F.col("report_type") == kind).drop("report_type"), f"{staging.path}/{kind}")
    both = readers.union_reports(*[readers.read_observations_csv(spark, f"{staging.path}/{kind}") for kind in (fixed.ROUTINE, fixed.SPECIAL)])
    planned = planning.plan_airport_months(spark, adapters.EVENTS)
    kept = readers.of_planned_months(readers.station_observations(both, stations_frame(spark, stations())), planned)
    writers.write_observations(kept, f"{staging.path}/weather")
    landed = file_order(f"{staging.path}/weather", spark, "valid_utc", "report_type")
    return landed.groupBy("airport_code", "year", "month").agg(
        F.count("*").alias("reports"), F.count_if(F.col("report_type") == fixed.SPECIAL).alias("special"),
        F.min("valid_utc").alias("first_report"), F.max("valid_utc").alias("last_report"), F.count_if("out_of_order").alias("out_of_order"))


@query("""SELECT step, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, count(*) * if(step = 'forced', 2, 1) AS flights,
    0::BIGINT AS out_of_order FROM flt, (VALUES ('first'), ('again'), ('forced')) s(step) GROUP BY 1, 2, 3""")
def landing_skips_months(spark, sf_dir):
    """Flights land once; a second run with twice the rows changes nothing, a forced one replaces the months."""
    raw, path = adapters.raw_flights(read(spark, sf_dir, "events")), f"{Staging(spark).path}/flights"
    runs, out = {"first": (raw, False), "again": (raw.union(raw), False), "forced": (raw.union(raw), True)}, []
    for step, (flights, force) in runs.items():
        writers.write_flights(flights, path, force)
        counted = file_order(path, spark, "FlightDate", "CRSDepTime").groupBy("year", "month").agg(
            F.count("*").alias("flights"), F.count_if("out_of_order").alias("out_of_order"))
        out.append(Staging(spark).write(step, counted.select(F.lit(step).alias("step"), "*")))
    return reduce(DataFrame.unionByName, out)


@query("""SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, count(*) AS flights, count(*) FILTER (is_cancelled) AS cancelled,
    true AS from_csv FROM flt WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND org IN ('AAA', 'BBB', 'CCC', 'DDD') GROUP BY 1, 2""")
def flight_landing(spark, sf_dir):
    """The landing job: missing months are read from their CSV, written, checked and summed up; files that
    are there are not read again."""
    raw = adapters.raw_flights(read(spark, sf_dir, "events"))
    staging = Staging(spark)
    writers.export_csv(raw, f"{staging.path}/csv/2024-1")
    chosen = select_events(adapters.EVENTS, ["ev_b", "ev_a"])
    source = lambda year, month: f"{staging.path}/csv/{year}-{month}"
    landed, _ = landing.land_flights(spark, source, f"{staging.path}/flights", chosen)
    skipped, _ = landing.land_flights(spark, lambda year, month: "nowhere", f"{staging.path}/flights", chosen)
    from_csv = spark.read.parquet(f"{staging.path}/flights").agg(F.bool_and(F.col("_source_file").endswith(".csv"))).first()[0]
    both = landed.select("year", "month", "flights", F.col("cancelled").cast("long").alias("cancelled")).unionByName(
        skipped.select("year", "month", "flights", F.col("cancelled").cast("long").alias("cancelled")))
    return both.withColumn("from_csv", F.lit(from_csv))


@query("""SELECT run, CAST(2024 AS INTEGER) AS year, m AS month, count(*) AS flights FROM flt, (VALUES ('first', 1, 0), ('again', 1, 0), ('again', 2, 1)) r(run, m, odd)
    WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-29' AND k % 2 = odd GROUP BY 1, 3""")
def landing_recovers(spark, sf_dir):
    """A month whose file has dates of another one is not published and lands with the next run; the good
    month of the failed run stays. Flights of odd ids are moved to February, first by 29 days too few."""
    raw, staging = adapters.raw_flights(read(spark, sf_dir, "events")).where("FlightDate < '2024-01-30'"), Staging(spark)
    odd = F.col("Flight_Number_Reporting_Airline") % 2 == 1
    writers.export_csv(raw.where(~odd), f"{staging.path}/csv/1")
    february = replace(adapters.EVENTS[0], event_id="ev_c", data_start=date(2024, 2, 1), data_end=date(2024, 2, 29),
                       storm_start=date(2024, 2, 8), storm_end=date(2024, 2, 9))
    path, out = f"{staging.path}/flights", []
    for run, moved in (("first", 2), ("again", 31)):
        writers.export_csv(raw.where(odd).withColumn("FlightDate", F.date_add("FlightDate", moved)), f"{staging.path}/csv/{run}")
        source = lambda year, month, run=run: f"{staging.path}/csv/{1 if month == 1 else run}"
        try:
            landing.land_flights(spark, source, path, [*adapters.EVENTS, february])
        except ValueError as error:
            if run != "first" or not str(error).startswith("2024-02: dates 2024-01"):
                raise
        counted = landing.read_landed(spark, path, f"{schemas.RAW_FLIGHTS}, year int, month int").groupBy("year", "month").agg(F.count("*").alias("flights"))
        out.append(staging.write(run, counted.select(F.lit(run).alias("run"), "*")))
    return reduce(DataFrame.unionByName, out)


@query("""SELECT org AS airport_code, CAST(year(l) AS INTEGER) AS year, CAST(month(l) AS INTEGER) AS month,
    CAST(sum(if(k % 5 = 0, 0, if(k % 50 = 1, 2, 1))) AS BIGINT) AS routine, CAST(sum(if(k % 5 = 0, 1, 0)) AS BIGINT) AS special
    FROM (SELECT *, timezone('America/Chicago', date_trunc('minute', ts) AT TIME ZONE 'UTC') AS l FROM wx)
    WHERE l >= TIMESTAMP '2023-12-01' AND l < TIMESTAMP '2024-02-01' GROUP BY 1, 2, 3""")
def weather_overlaps(spark, sf_dir):
    """The landing job over monthly files that reach two days into the next month: every report comes from its
    own month's file, and those that a file repeats stay."""
    raw, staging = adapters.raw_observations(read(spark, sf_dir, "events")), Staging(spark)
    text = raw.withColumn("valid", F.date_format("valid_utc", "yyyy-MM-dd HH:mm")).drop("airport_code")
    twice = (F.col("report_type") == fixed.ROUTINE) & (F.col("relh") % 50 == 1)
    repeated = text.withColumn("_copy", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")
    files = {12: F.col("valid_utc") < "2024-01-03", 1: F.col("valid_utc") >= "2023-12-30"}
    for month, inside in files.items():
        repeated.where(inside).drop("valid_utc").withColumns({"at": F.col("station"), "kind": F.col("report_type")}).drop("report_type").write.option(
            "header", True).partitionBy("at", "kind").csv(f"{staging.path}/csv/{month}")
    source = lambda station, kind, year, month: f"{staging.path}/csv/{month}/at={station}/kind={kind}"
    window = replace(adapters.EVENTS[0], data_start=date(2023, 12, 31), data_end=date(2024, 1, 31))
    batches, _ = landing.land_observations(spark, source, f"{staging.path}/weather", [window], stations())
    return batches.select("airport_code", "year", "month", "routine", "special")


@query("""SELECT b.event_id, b.airport_code, if(b.airline_group = 'American', 'One', 'Other') AS airline_group,
    CAST(sum(departures_before) AS BIGINT) AS departures_before, CAST(sum(cancelled_before) AS BIGINT) AS cancelled_before,
    CAST(sum(departures_during) AS BIGINT) AS departures_during, CAST(sum(cancelled_during) AS BIGINT) AS cancelled_during FROM aw b GROUP BY 1, 2, 3""")
def seeded_groups(spark, sf_dir):
    """Airline groups and events from seed files instead of the constants."""
    staging = Staging(spark)
    writers.export_csv(spark.createDataFrame([("AA", "One", "A"), ("MQ", "One", "B")], schemas.AIRLINE_GROUPS), f"{staging.path}/groups")
    writers.export_csv(events_frame(spark, adapters.EVENTS).drop("label"), f"{staging.path}/events")
    groups = readers.read_seed(spark, f"{staging.path}/groups", schemas.AIRLINE_GROUPS)
    events = events_from_seed(readers.read_seed(spark, f"{staging.path}/events", schemas.STORM_EVENTS), {}, adapters.AIRPORTS)
    source = read(spark, sf_dir, "events")
    wh = Warehouse(spark, lambda: adapters.raw_flights(source), lambda: adapters.raw_observations(source), events, PARAMS, groups)
    return wh.view("airline_windows")


@query("""SELECT 'mart_storm_summary' AS table_name, false AS is_view, count(*) AS table_rows FROM summ
    UNION ALL SELECT 'mart_storm_timeline', false, count(*) FROM tl UNION ALL SELECT 'prep_weather_hourly', false, count(*) FROM weather
    UNION ALL SELECT 'stg_flights', true, count(*) FROM flt""")
def saved_models(spark, sf_dir):
    """Models as catalog tables and views, saved twice and counted."""
    database = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    with warehouse(spark, sf_dir) as wh:
        for _ in range(2):
            wh.save(database, f"{database}_", buckets=8)
        counts = []
        for name, view in (("mart_storm_summary", False), ("mart_storm_timeline", False), ("prep_weather_hourly", False), ("stg_flights", True)):
            table = spark.table(f"{database}_{name}" if view else f"{database}.{name}")
            counts.append(table.agg(F.count("*").alias("table_rows")).select(F.lit(name).alias("table_name"), F.lit(view).alias("is_view"), "table_rows"))
        result = Staging(spark).write("counts", reduce(DataFrame.unionByName, counts))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return result


@query("""SELECT airport_code, count(*) AS departures, count(*) FILTER (has_winter_precip) AS in_winter, count(*) FILTER (is_cancelled) AS cancelled
    FROM (SELECT origin_airport AS airport_code, has_winter_precip, is_cancelled FROM fw WHERE scheduled_dep_hour >= TIMESTAMP '2024-01-01') GROUP BY 1""")
def saved_hours_joined(spark, sf_dir):
    """Departures of a month with the saved weather hours of that month: only its folder is read, and the bucketed
    hours are joined as they lie."""
    database = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    with warehouse(spark, sf_dir) as wh:
        wh.save_model("weather_hourly", database, buckets=8)
        saved = spark.table(f"{database}.prep_weather_hourly").where("saved_month >= '2024-01-01'").drop("saved_month")
        joined = hourly.flights_weather(wh.view("departures").where("scheduled_dep_hour >= timestamp_ntz '2024-01-01'"), saved.hint("merge"))
        result = Staging(spark).write("joined", joined.groupBy(F.col("origin_airport").alias("airport_code")).agg(
            F.count("*").alias("departures"), F.count_if("has_winter_precip").alias("in_winter"), F.count_if("is_cancelled").alias("cancelled")))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return result


# --- data quality ----------------------------------------------------------------------------------

def results_sql(*rows: tuple[str, ...]) -> str:
    """UNION of one row per check: check, model, column, statement that counts violations, severity if not error."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "check", '{m}' AS model, '{col}' AS "column", CAST(({n}) AS BIGINT) AS violations, '{(*s, "error")[0]}' AS severity"""
        for c, m, col, n, *s in rows)


def results(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query(results_sql(
    ("unique", "lineitem", "line_key", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    ("unique", "orders", "o_orderkey", "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)"),
    ("unique", "observations", "metar_id", count_of("unique", "observations", "metar_id"))))
def dq_unique(spark, sf_dir):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key")
    return results(
        checks.unique(read(spark, sf_dir, "lineitem").select(key), "lineitem", "line_key"),
        checks.unique(read(spark, sf_dir, "orders"), "orders", "o_orderkey"),
        checks.unique(warehouse(spark, sf_dir).view("observations"), "observations", "metar_id"))


@query(results_sql(
    ("not_null", "observations", "metar_id", count_of("not_null", "observations", "metar_id")),
    ("not_null", "observations", "temp_c", "SELECT count(*) - count(temp_c) FROM obs"),
    ("not_null", "observations", "weather_codes", "SELECT count(*) - count(codes) FROM obs")))
def dq_not_null(spark, sf_dir):
    rules = checks.Rules(not_null=("metar_id", "temp_c", "weather_codes"))
    return checks.row_rules(warehouse(spark, sf_dir).view("observations"), "observations", rules)


@query(results_sql(
    ("accepted_values", "flights_clean", "cancellation_code", count_of("accepted_values", "flights_clean", "cancellation_code", "ABCD")),
    ("accepted_values", "flights_clean", "dest_airport", "SELECT count(*) FROM flt WHERE dst = 'ZZZ'")))
def dq_accepted(spark, sf_dir):
    rules = checks.Rules(accepted={"cancellation_code": ("A", "B", "C", "D"), "dest_airport": PARAMS.airports})
    return checks.row_rules(warehouse(spark, sf_dir).view("flights_clean"), "flights_clean", rules)


@query(results_sql(
    ("relationships", "orders", "o_custkey", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    ("relationships", "lineitem", "l_orderkey", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    ("relationships", "lineitem of F", "l_orderkey", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN "
     "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")))
def dq_relationships(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return results(
        checks.relationships(orders, "orders", "o_custkey", read(spark, sf_dir, "customer"), "c_custkey"),
        checks.relationships(read(spark, sf_dir, "lineitem"), "lineitem", "l_orderkey", orders, "o_orderkey"),
        checks.relationships(read(spark, sf_dir, "lineitem"), "lineitem of F", "l_orderkey",
                             orders.where("o_orderstatus = 'F'"), "o_orderkey"))


@query(results_sql(
    ("consistent_counts", "airport_hourly", "", ACROSS["consistent_counts", "airport_hourly"]),
    ("consistent_counts", "without_carrier", "", "SELECT count(*) FROM hrs WHERE cancelled_carrier > 0")))
def dq_hour_counts(spark, sf_dir):
    hours = warehouse(spark, sf_dir).table("airport_hourly")
    broken = hours.withColumn("cancelled_carrier", F.lit(0))
    return results(checks.violations(checks.inconsistent_hours(hours), "consistent_counts", "airport_hourly"),
                   checks.violations(checks.inconsistent_hours(broken), "consistent_counts", "without_carrier"))


@query("""SELECT * FROM (
    SELECT 'all hours' AS hours, (SELECT CAST(sum(scheduled_departures) AS BIGINT) FROM hrs) AS in_mart, (SELECT count(*) FROM flt) AS in_source
    UNION ALL SELECT 'one event', (SELECT CAST(sum(scheduled_departures) AS BIGINT) FROM hrs WHERE event_id = 'ev_a'), (SELECT count(*) FROM flt)
    ) WHERE in_mart <> in_source""")
def dq_departures_kept(spark, sf_dir):
    """Totals that differ: none for the whole table, and those of one event's hours as a control."""
    wh = warehouse(spark, sf_dir)
    hours = wh.table("airport_hourly")
    whole = checks.lost_departures(hours, wh.view("flights")).select(F.lit("all hours").alias("hours"), "*")
    part = checks.lost_departures(hours.where("event_id = 'ev_a'"), wh.view("flights"))
    return whole.union(part.select(F.lit("one event").alias("hours"), "*"))


@query("""SELECT * FROM (
    SELECT 'all' AS timeline, event_id, airport_code, count(*) AS hours, min(hours_from_onset) AS first_hour, max(hours_from_onset) AS last_hour
    FROM tl GROUP BY 2, 3
    UNION ALL SELECT 'dry', event_id, airport_code, count(*), min(hours_from_onset), max(hours_from_onset)
    FROM tl WHERE NOT has_winter_precip OR has_winter_precip IS NULL GROUP BY 2, 3) WHERE hours <> 144 OR first_hour <> -48 OR last_hour <> 95""")
def dq_timeline_complete(spark, sf_dir):
    """Incomplete pairs: none as built, and as a control every pair without the winter hours."""
    timeline = warehouse(spark, sf_dir).table("storm_timeline")
    dry = timeline.where(~F.coalesce("has_winter_precip", F.lit(False)))
    return checks.incomplete_timelines(timeline, PARAMS).select(F.lit("all").alias("timeline"), "*").union(
        checks.incomplete_timelines(dry, PARAMS).select(F.lit("dry").alias("timeline"), "*"))


@query(results_sql(*all_checks(checks.declared_rules(PARAMS))))
def dq_all(spark, sf_dir):
    """Every declared and cross-model check on every model; the storm onset only warns."""
    return checks.run_checks(warehouse(spark, sf_dir).models(), PARAMS)


def outcomes_sql(rules: dict[str, checks.Rules], variant: str) -> str:
    """What `checked_build` makes of each model, from the counts of all checks."""
    rows = [row for row in all_checks(rules) if row[1] in LAYERS]

    def ancestors(model: str) -> set[str]:
        return set(PARENTS[model]).union(*(ancestors(p) for p in PARENTS[model]))

    pairs = ", ".join(f"('{m}', '{a}')" for m in LAYERS for a in sorted(ancestors(m)))
    return f"""SELECT '{variant}' AS variant, m.model, if(h.model IS NOT NULL, 'held back', if(e.model IS NOT NULL, 'failed', 'built')) AS status,
        if(h.model IS NOT NULL, '', coalesce(e.texts, '')) AS errors, if(h.model IS NOT NULL, '', coalesce(w.texts, '')) AS warnings
    FROM (SELECT unnest({list(LAYERS)}) AS model) m
    LEFT JOIN (SELECT model, string_agg(trim("check" || ' ' || "column"), ', ' ORDER BY "check", "column") AS texts FROM ({results_sql(*rows)})
        WHERE violations > 0 AND severity = 'error' GROUP BY 1) e USING (model)
    LEFT JOIN (SELECT model, string_agg(trim("check" || ' ' || "column"), ', ' ORDER BY "check", "column") AS texts FROM ({results_sql(*rows)})
        WHERE violations > 0 AND severity = 'warn' GROUP BY 1) w USING (model)
    LEFT JOIN (SELECT DISTINCT p.model FROM (VALUES {pairs}) p(model, ancestor) JOIN ({results_sql(*rows)}) c ON c.model = p.ancestor
        WHERE violations > 0 AND severity = 'error') h USING (model)"""


DECLARED = checks.declared_rules(PARAMS)
#: The declared rules, but hours and flights outside all events only warn.
LENIENT = {name: replace(r, warn=(*r.warn, "event_id")) if name in ("airport_hourly", "flights_weather") else r for name, r in DECLARED.items()}


@query(outcomes_sql(DECLARED, "declared") + " UNION ALL " + outcomes_sql(LENIENT, "lenient"))
def checked_build(spark, sf_dir):
    """Which models a build that checks as it goes makes, and which it holds back: the local months reach beyond
    the events, which is an error as declared; as a warning it holds nothing back."""
    parts = []
    with warehouse(spark, sf_dir) as wh:  # the second build finds what the first one made
        for variant, rules in (("declared", DECLARED), ("lenient", LENIENT)):
            frame = build.outcome_frame(wh, build.checked_build(wh, rules)).drop("because_of")
            parts.append(frame.select(F.lit(variant).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT year, month, count(*) AS repeated, CAST(sum(n) AS BIGINT) AS flights FROM (
    SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, d, carrier, k, org, count(*) * 2 AS n FROM flt
    WHERE k % 10 = 3 GROUP BY ALL) GROUP BY 1, 2""")
def landed_keys(spark, sf_dir):
    """Flights that a landed month holds more than once: every tenth was written twice."""
    raw, path = adapters.raw_flights(read(spark, sf_dir, "events")), f"{Staging(spark).path}/flights"
    writers.write_flights(raw.union(raw.where("Flight_Number_Reporting_Airline % 10 = 3")), path)
    landed = landing.read_landed(spark, path, f"{schemas.RAW_FLIGHTS}, year int, month int")
    found = checks.repeated_keys(landed, writers.MONTH, planning.FLIGHT_KEY).groupBy("year", "month").agg(
        F.count("*").alias("repeated"), F.sum("n").alias("flights"))
    return Staging(spark).write("found", found)


# --- contract --------------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    return warehouse(spark, "/root/testdata/sf0.001").view("storm_summary")


def corpus_queries() -> dict[str, Query]:
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run} if corpus else {}


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in _registry.items()} | corpus_queries()


def oracle_sql() -> dict[str, str]:
    known = {name: statement(sql) for name, (_, sql) in _registry.items() if sql}
    if corpus:
        known |= {**corpus.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql}
