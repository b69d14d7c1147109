"""DuckDB statements that state the expected result of each registered query, straight from `events`.

They follow other routes than the Spark code where there is one: no text stage, islands by row
numbers, top rows by ranking, frames by extremes.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

# Named building blocks in order; a statement gets the blocks it needs and those they need.
BLOCKS: dict[str, str] = {}

BLOCKS["src"] = """
SELECT event_id AS k, ts, event_type AS kind, value, day(ts) AS dom, CAST(ts AS DATE) AS d,
       ['AAA', 'BBB', 'CCC', 'DDD'][user_id % 4 + 1] AS org,
       ['AAA', 'BBB', 'CCC', 'DDD', 'ZZZ'][(user_id // 24) % 5 + 1] AS dst,
       ['AA', 'MQ', 'WN', 'UA', 'DL', 'XX'][(user_id // 4) % 6 + 1] AS carrier, user_id
FROM events"""

BLOCKS["ev"] = """
SELECT * FROM (VALUES
  ('ev_a', 'Event A', 'A, early January', DATE '2024-01-01', DATE '2024-01-15', DATE '2024-01-10', DATE '2024-01-12'),
  ('ev_b', 'Event B', 'B, late January', DATE '2024-01-16', DATE '2024-01-29', DATE '2024-01-24', DATE '2024-01-25')
) t(event_id, event_name, label, data_start, data_end, storm_start, storm_end)"""

BLOCKS["grp"] = """
SELECT * FROM (VALUES ('AA', 'American'), ('MQ', 'American'), ('WN', 'Southwest'), ('UA', 'United'), ('DL', 'Delta')
) t(carrier, airline_group)"""

BLOCKS["wx"] = """
SELECT *, CASE
    WHEN dom IN (8, 10, 11, 12, 24, 25) AND kind = 'error' THEN '-FZRA BR'
    WHEN dom IN (8, 10, 11, 12, 24, 25) AND kind = 'signup' THEN if(k % 2 = 0, 'SN', 'PL')
    WHEN kind = 'purchase' THEN if(dom = 20, 'TSRA', ['VCTS', 'BLSN', '-DRSN'][k % 3 + 1])
    WHEN kind = 'click' AND k % 4 = 0 THEN 'RA'
    WHEN kind = 'error' AND k % 4 = 0 THEN 'FG'
    WHEN kind IN ('error', 'signup') THEN 'BR' END AS codes
FROM src"""

BLOCKS["obs"] = """
SELECT k, org AS airport_code, timezone('America/Chicago', ts AT TIME ZONE 'UTC') AS valid_local, k % 5 = 0 AS is_special, codes,
       md5(concat_ws('|', org, ts, if(k % 5 = 0, 'special', 'routine'))) AS metar_id,
       CASE WHEN k % 11 <> 0 THEN round((floor(value) - 32) * 5 / 9, 1) END AS temp_c,
       CASE WHEN k % 7 <> 0 THEN round((floor(value / 2) - 32) * 5 / 9, 1) END AS dewpoint_c,
       CAST(k % 100 AS DOUBLE) AS rel_humidity_pct,
       CAST(k % 36 * 10 AS DOUBLE) AS wind_dir_deg,
       round(CAST(k % 40 AS DOUBLE) * 1.852, 1) AS wind_speed_kmh,
       CASE WHEN k % 3 = 0 THEN round(CAST(k % 60 + 10 AS DOUBLE) * 1.852, 1) END AS wind_gust_kmh,
       round((k % 40 + 1) / 4 * CAST(1.609344 AS DOUBLE), 2) AS visibility_km,
       nullif(['FEW', 'SCT', 'BKN', 'OVC', 'M'][k % 5 + 1], 'M') AS sky_cover_lowest,
       CASE WHEN k % 6 <> 0 THEN round(CAST(k % 120 * 100 AS DOUBLE) * 0.3048) END AS cloud_base_lowest_m,
       CASE WHEN kind = 'view' THEN 0.0 WHEN k % 13 <> 0 THEN round((k % 50) / 100 * CAST(25.4 AS DOUBLE), 2) END AS precip_mm,
       kind = 'view' AS is_precip_trace,
       CASE WHEN k % 19 = 0 THEN 0.0 WHEN k % 4 = 0 THEN round((k % 30) / 100 * CAST(25.4 AS DOUBLE), 2) END AS ice_accretion_1h_mm,
       k % 19 = 0 AS is_ice_accretion_trace,
       trim(regexp_replace(' ' || coalesce(codes, ''), ' [-+]?(VC|BL|DR)[^ ]*', '', 'g')) AS codes_text
FROM wx"""

BLOCKS["flagged"] = """
SELECT *, contains(codes_text, 'FZRA') OR contains(codes_text, 'FZDZ') AS has_freezing_rain,
       contains(codes_text, 'PL') AS has_ice_pellets,
       contains(codes_text, 'SN') OR contains(codes_text, 'SG') AS has_snow,
       regexp_matches(regexp_replace(codes_text, 'FZ(RA|DZ)', '', 'g'), 'RA|DZ') AS has_rain,
       contains(codes_text, 'FG') AS has_fog, contains(codes_text, 'TS') AS has_thunder,
       date_trunc('hour', valid_local + INTERVAL 7 MINUTE) AS weather_hour
FROM obs"""

BLOCKS["obs_hour"] = """
SELECT airport_code, weather_hour, count(*) AS n_reports, count(*) FILTER (is_special) AS n_special_reports,
       arg_max(temp_c, valid_local) FILTER (NOT is_special) AS temp_c,
       arg_max(dewpoint_c, valid_local) FILTER (NOT is_special) AS dewpoint_c,
       arg_max(precip_mm, valid_local) FILTER (NOT is_special) AS precip_mm,
       min(temp_c) AS temp_min_c, max(wind_speed_kmh) AS wind_speed_max_kmh, max(wind_gust_kmh) AS wind_gust_max_kmh,
       min(visibility_km) AS visibility_min_km, max(ice_accretion_1h_mm) AS ice_accretion_max_mm,
       max(has_freezing_rain) AS has_freezing_rain, max(has_ice_pellets) AS has_ice_pellets, max(has_snow) AS has_snow,
       max(has_rain) AS has_rain, max(has_fog) AS has_fog, max(has_thunder) AS has_thunder,
       string_agg(DISTINCT codes_text, ' | ' ORDER BY codes_text) FILTER (codes_text <> '') AS weather_codes_hour
FROM flagged GROUP BY 1, 2"""

BLOCKS["grid"] = """
SELECT airport_code, h AS weather_hour
FROM (SELECT DISTINCT airport_code, date_trunc('month', valid_local) AS m FROM obs) s,
     LATERAL (SELECT unnest(range(s.m, s.m + INTERVAL 1 MONTH, INTERVAL 1 HOUR)) AS h) g"""

BLOCKS["weather"] = """
SELECT md5(concat_ws('|', g.airport_code, g.weather_hour)) AS weather_hour_id, g.airport_code, g.weather_hour,
       CAST(g.weather_hour AS DATE) AS weather_date, o.airport_code IS NOT NULL AS has_report,
       ifnull(n_reports, 0) AS n_reports, ifnull(n_special_reports, 0) AS n_special_reports,
       temp_c, dewpoint_c, temp_min_c, precip_mm, wind_speed_max_kmh, wind_gust_max_kmh, visibility_min_km,
       ice_accretion_max_mm, has_freezing_rain, has_ice_pellets, has_snow, has_rain, has_fog, has_thunder,
       has_freezing_rain OR has_ice_pellets OR has_snow AS has_winter_precip,
       CASE WHEN o.airport_code IS NOT NULL THEN list_extract(list_filter(
           [if(has_freezing_rain, 'freezing_rain', ''), if(has_ice_pellets, 'ice_pellets', ''), if(has_snow, 'snow', ''),
            if(has_rain, 'rain', ''), if(has_fog, 'fog', ''), 'none'], lambda x: x <> ''), 1) END AS weather_group,
       weather_codes_hour
FROM grid g LEFT JOIN obs_hour o ON o.airport_code = g.airport_code AND o.weather_hour = g.weather_hour"""

BLOCKS["flt0"] = """
SELECT *, date_trunc('minute', ts) AS sched,
       CASE WHEN dom IN (11, 12, 13, 25, 26) THEN kind IN ('error', 'signup', 'click')
            WHEN dom IN (3, 8, 20) THEN kind = 'click' ELSE value > 400 END AS is_cancelled,
       CASE WHEN k % 17 <> 0 THEN round(value / 3) END AS dep_delay_min,
       (extract('hour' FROM ts) * 60 + extract('minute' FROM ts) + k % 300 - 60 + 1440) % 1440 AS arr_minute
FROM src"""

BLOCKS["flt"] = """
SELECT *, md5(concat_ws('|', d, carrier, k, org)) AS flight_id,
       CASE WHEN is_cancelled THEN ['B', 'B', 'B', 'A', 'C'][k % 5 + 1] END AS cancellation_code,
       CASE WHEN is_cancelled THEN ['weather', 'weather', 'weather', 'carrier', 'nas'][k % 5 + 1] END AS reason,
       date_trunc('hour', ts) AS dep_hour, k % 97 = 0 AS is_diverted, NOT is_cancelled AND dep_delay_min >= 15 AS late,
       CAST(10 + k % 30 AS DOUBLE) AS taxi_out_min,
       CAST(d AS TIMESTAMP) + to_minutes(if(arr_minute = 0, 1440, arr_minute)) AS arr_clock
FROM flt0"""

BLOCKS["arr"] = """
SELECT *, CASE WHEN dst <> 'ZZZ' THEN
       arr_clock + if(date_diff('minute', arr_clock, sched) > 360, INTERVAL 1 DAY, INTERVAL 0 DAY) END AS scheduled_arr_ts
FROM flt"""

BLOCKS["dep"] = """
SELECT org AS airport_code, dep_hour AS weather_hour, count(*) AS scheduled_departures,
       count(*) FILTER (is_cancelled) AS cancelled, count(*) FILTER (reason = 'weather') AS cancelled_weather,
       count(*) FILTER (reason = 'carrier') AS cancelled_carrier, count(*) FILTER (reason = 'nas') AS cancelled_nas,
       count(*) FILTER (reason = 'security') AS cancelled_security, count(*) FILTER (is_diverted) AS diverted,
       count(*) FILTER (late) AS delayed_15,
       avg(if(is_cancelled, NULL, dep_delay_min)) AS avg_dep_delay_min, avg(if(is_cancelled, NULL, taxi_out_min)) AS avg_taxi_out_min
FROM flt GROUP BY 1, 2"""

BLOCKS["hrs"] = """
SELECT weather_hour_id AS airport_hour_id, w.airport_code, w.weather_hour, weather_date, event_id,
       CASE WHEN w.weather_hour >= storm_start AND CAST(w.weather_hour AS DATE) <= storm_end THEN 'storm'
            WHEN w.weather_hour < storm_start THEN 'before' ELSE 'after' END AS storm_period,
       date_diff('hour', CAST(storm_start AS TIMESTAMP), w.weather_hour) AS hours_from_storm_start,
       ifnull(scheduled_departures, 0) AS scheduled_departures, ifnull(cancelled, 0) AS cancelled,
       ifnull(cancelled_weather, 0) AS cancelled_weather, ifnull(cancelled_carrier, 0) AS cancelled_carrier,
       ifnull(cancelled_nas, 0) AS cancelled_nas, ifnull(cancelled_security, 0) AS cancelled_security,
       ifnull(diverted, 0) AS diverted, ifnull(delayed_15, 0) AS delayed_15,
       CASE WHEN scheduled_departures > 0 THEN round(cancelled / scheduled_departures, 4) END AS cancellation_rate,
       CASE WHEN scheduled_departures > cancelled THEN round(delayed_15 / (scheduled_departures - cancelled), 4) END AS delay_15_rate,
       round(avg_dep_delay_min, 1) AS avg_dep_delay_min, round(avg_taxi_out_min, 1) AS avg_taxi_out_min,
       has_report AS has_weather_report, weather_group, has_winter_precip, has_freezing_rain, has_ice_pellets, has_snow,
       temp_c, temp_min_c, precip_mm, ice_accretion_max_mm, visibility_min_km, wind_gust_max_kmh
FROM weather w LEFT JOIN dep USING (airport_code, weather_hour)
LEFT JOIN ev ON weather_date >= data_start AND weather_date <= data_end"""

BLOCKS["fw"] = """
SELECT f.flight_id, f.d AS flight_date, f.carrier AS airline_code, f.k AS flight_number,
       f.org AS origin_airport, f.dst AS dest_airport, f.sched AS scheduled_dep_ts, f.dep_hour AS scheduled_dep_hour,
       event_id, event_name,
       CASE WHEN f.d >= storm_start AND f.d <= storm_end THEN 'storm' WHEN f.d < storm_start THEN 'before' ELSE 'after' END AS storm_period,
       date_diff('hour', CAST(storm_start AS TIMESTAMP), f.dep_hour) AS hours_from_storm_start,
       f.is_cancelled, f.cancellation_code, f.reason AS cancellation_reason, f.is_diverted, f.dep_delay_min,
       f.late AS is_dep_delayed_15, f.taxi_out_min, CAST(f.k % 25 AS DOUBLE) AS weather_delay_min,
       CAST(f.k % 15 AS DOUBLE) AS carrier_delay_min, CAST(f.k % 10 AS DOUBLE) AS nas_delay_min,
       CAST(f.k % 20 AS DOUBLE) AS late_aircraft_delay_min,
       weather_hour_id, has_report AS has_weather_report, weather_group, has_winter_precip, has_freezing_rain,
       has_ice_pellets, has_snow, temp_c, temp_min_c, precip_mm, ice_accretion_max_mm, visibility_min_km, wind_gust_max_kmh
FROM flt f LEFT JOIN weather w ON w.airport_code = f.org AND w.weather_hour = f.dep_hour
LEFT JOIN ev ON f.d >= data_start AND f.d <= data_end"""

BLOCKS["searched"] = """
SELECT h.* FROM hrs h JOIN ev USING (event_id)
WHERE weather_date BETWEEN storm_start - 3 AND storm_end + 3"""

BLOCKS["winter"] = """
SELECT event_id, airport_code, weather_hour,
       weather_hour - to_hours(row_number() OVER p) AS island,
       lag(weather_hour) OVER p AS previous
FROM searched WHERE has_winter_precip WINDOW p AS (PARTITION BY event_id, airport_code ORDER BY weather_hour)"""

BLOCKS["numbered"] = """
SELECT event_id, airport_code, weather_hour,
       1 + count(*) FILTER (previous <= weather_hour - INTERVAL 24 HOUR) OVER p AS episode_number,
       dense_rank() OVER (PARTITION BY event_id, airport_code ORDER BY island) AS run_number
FROM winter WINDOW p AS (PARTITION BY event_id, airport_code ORDER BY weather_hour
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

BLOCKS["runs"] = """
SELECT event_id, airport_code, run_number, min(weather_hour) AS run_start, max(weather_hour) AS run_end, count(*) AS run_hours
FROM numbered GROUP BY 1, 2, 3"""

BLOCKS["episode"] = """
SELECT event_id, airport_code, episode_number, min(weather_hour) AS first_hour, max(weather_hour) AS last_hour, count(*) AS n,
       row_number() OVER (PARTITION BY event_id, airport_code ORDER BY count(*) DESC, episode_number) AS place,
       count(*) OVER (PARTITION BY event_id, airport_code) AS n_winter_episodes
FROM numbered GROUP BY 1, 2, 3"""

BLOCKS["main"] = """
SELECT e.event_id, e.airport_code, e.first_hour AS storm_onset, e.last_hour AS precip_end, e.n_winter_episodes,
       (SELECT min(run_start) FROM runs r WHERE r.event_id = e.event_id AND r.airport_code = e.airport_code
        AND r.run_hours >= 6 AND r.run_start >= e.first_hour AND r.run_start <= e.last_hour) AS sustained_onset
FROM episode e WHERE place = 1"""

BLOCKS["mass"] = """
SELECT s.event_id, s.airport_code, min(s.weather_hour) AS first_mass_cancel_hour
FROM searched s JOIN main m USING (event_id, airport_code)
WHERE s.scheduled_departures > 2 AND s.cancellation_rate >= 0.5
  AND date_diff('hour', s.weather_hour, m.storm_onset) <= 24
GROUP BY 1, 2"""

BLOCKS["recov"] = """
SELECT event_id, airport_code, min(weather_hour) AS recovery_hour FROM (
  SELECT h.event_id, h.airport_code, h.weather_hour,
         max(h.cancellation_rate) OVER p AS worst, lead(h.weather_hour, 5) OVER q AS sixth
  FROM hrs h JOIN main m USING (event_id, airport_code)
  WHERE h.weather_hour > m.precip_end AND h.scheduled_departures > 2
  WINDOW p AS (PARTITION BY event_id, airport_code ORDER BY h.weather_hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING),
         q AS (PARTITION BY event_id, airport_code ORDER BY h.weather_hour))
WHERE sixth IS NOT NULL AND worst < 0.1 GROUP BY 1, 2"""

BLOCKS["bnd"] = """
SELECT m.*, first_mass_cancel_hour, recovery_hour, coalesce(recovery_hour, precip_end + INTERVAL 1 HOUR) AS until
FROM main m LEFT JOIN mass USING (event_id, airport_code) LEFT JOIN recov USING (event_id, airport_code)"""

BLOCKS["totals"] = """
SELECT b.event_id, b.airport_code,
       count(CASE WHEN e AND has_winter_precip THEN 1 END) AS winter_precip_hours,
       count(CASE WHEN e AND has_freezing_rain THEN 1 END) AS freezing_rain_hours,
       count(CASE WHEN e AND has_ice_pellets THEN 1 END) AS ice_pellets_hours,
       count(CASE WHEN e AND has_snow THEN 1 END) AS snow_hours,
       min(temp_min_c) AS min_temp_c, max(ice_accretion_max_mm) AS max_ice_accretion_mm,
       min(CASE WHEN e THEN temp_min_c END) AS episode_min_temp_c, max(CASE WHEN e THEN ice_accretion_max_mm END) AS episode_max_ice_accretion_mm,
       CAST(sum(CASE WHEN before THEN scheduled_departures END) AS BIGINT) AS pre_onset_departures,
       CAST(sum(CASE WHEN before THEN cancelled END) AS BIGINT) AS pre_onset_cancelled,
       CAST(sum(CASE WHEN disrupted THEN scheduled_departures END) AS BIGINT) AS disruption_departures,
       CAST(sum(CASE WHEN disrupted THEN cancelled END) AS BIGINT) AS disruption_cancelled,
       CAST(sum(CASE WHEN disrupted THEN cancelled_weather END) AS BIGINT) AS disruption_cancelled_weather
FROM bnd b JOIN (
    SELECT h.*, h.weather_hour BETWEEN x.storm_onset AND x.precip_end AS e,
           date_diff('hour', h.weather_hour, x.storm_onset) BETWEEN 1 AND 24 AS before,
           h.weather_hour >= x.storm_onset AND h.weather_hour < x.until AS disrupted
    FROM hrs h JOIN bnd x USING (event_id, airport_code)) q USING (event_id, airport_code)
GROUP BY 1, 2"""

BLOCKS["summ"] = """
SELECT md5(concat_ws('|', p.event_id, p.airport_code)) AS storm_airport_id, p.event_id, p.airport_code,
       storm_onset, precip_end, 1 + date_diff('hour', storm_onset, precip_end) AS storm_duration_h, n_winter_episodes,
       winter_precip_hours, freezing_rain_hours, ice_pellets_hours, snow_hours, min_temp_c, max_ice_accretion_mm, episode_min_temp_c, episode_max_ice_accretion_mm,
       sustained_onset, first_mass_cancel_hour,
       date_diff('hour', storm_onset, first_mass_cancel_hour) AS lag_to_mass_cancel_h,
       date_diff('hour', sustained_onset, first_mass_cancel_hour) AS lag_from_sustained_h,
       recovery_hour, date_diff('hour', precip_end, recovery_hour) AS recovery_h,
       pre_onset_departures, pre_onset_cancelled,
       CASE WHEN pre_onset_departures > 0 THEN round(pre_onset_cancelled / pre_onset_departures, 4) END AS pre_onset_cancel_rate,
       disruption_departures, disruption_cancelled,
       CASE WHEN disruption_departures > 0 THEN round(disruption_cancelled / disruption_departures, 4) END AS disruption_cancel_rate,
       CASE WHEN disruption_cancelled > 0 THEN round(disruption_cancelled_weather / disruption_cancelled, 4) END AS weather_reason_share
FROM (SELECT DISTINCT event_id, airport_code FROM searched) p
LEFT JOIN bnd USING (event_id, airport_code) LEFT JOIN totals USING (event_id, airport_code)"""

BLOCKS["zero"] = """
SELECT event_id, airport_code, ifnull(sustained_onset, storm_onset) AS onset_hour,
       sustained_onset IS NOT NULL AS has_sustained_onset, precip_end, recovery_h, storm_onset
FROM summ WHERE storm_onset IS NOT NULL"""

BLOCKS["axis"] = """
SELECT h.*, z.onset_hour, z.has_sustained_onset, z.precip_end, z.recovery_h,
       date_diff('hour', z.onset_hour, h.weather_hour) AS hours_from_onset
FROM hrs h JOIN zero z USING (event_id, airport_code)"""

BLOCKS["tl"] = """
SELECT airport_hour_id, event_id, event_name, airport_code, weather_hour, onset_hour, has_sustained_onset, hours_from_onset,
       CAST(hours_from_onset - ((hours_from_onset % 3) + 3) % 3 AS INTEGER) AS hours_from_onset_3h,
       CASE WHEN hours_from_onset < 0 THEN 'before' WHEN weather_hour <= precip_end THEN 'precipitation'
            WHEN date_diff('hour', precip_end, weather_hour) >= recovery_h THEN 'normal' ELSE 'recovery' END AS storm_phase,
       scheduled_departures, cancelled, scheduled_departures - cancelled AS operated_departures, delayed_15, cancellation_rate,
       scheduled_departures > 2 AS is_busy_hour, has_winter_precip, weather_group, temp_c
FROM axis JOIN ev USING (event_id) WHERE hours_from_onset BETWEEN -48 AND 95"""

BLOCKS["near"] = """
SELECT f.event_id, f.origin_airport AS airport_code, ifnull(g.airline_group, 'Other') AS airline_group,
       f.is_cancelled, f.cancellation_code, f.scheduled_dep_hour < z.onset_hour AS is_before
FROM fw f JOIN zero z ON z.event_id = f.event_id AND z.airport_code = f.origin_airport
LEFT JOIN grp g ON g.carrier = f.airline_code
WHERE date_diff('hour', f.scheduled_dep_hour, z.onset_hour) <= 24 AND f.scheduled_dep_hour <= z.precip_end"""

BLOCKS["aw"] = """
SELECT event_id, airport_code, airline_group, count(*) FILTER (is_before) AS departures_before,
       count(*) FILTER (is_before AND is_cancelled) AS cancelled_before,
       count(*) FILTER (NOT is_before) AS departures_during,
       count(*) FILTER (NOT is_before AND is_cancelled) AS cancelled_during
FROM near GROUP BY 1, 2, 3"""

BLOCKS["op"] = """
SELECT f.event_id, f.origin_airport AS airport_code, ifnull(g.airline_group, 'Other') AS airline_group,
       ifnull(has_winter_precip, false) AS w, dep_delay_min, taxi_out_min
FROM fw f LEFT JOIN grp g ON g.carrier = f.airline_code
WHERE NOT is_cancelled AND (has_winter_precip OR weather_group = 'none')"""

BLOCKS["med"] = """
SELECT event_id, airport_code, airline_group, count(*) FILTER (w) AS operated_winter,
       median(dep_delay_min) FILTER (w) AS median_delay_winter_min, median(dep_delay_min) FILTER (NOT w) AS median_delay_normal_min,
       median(taxi_out_min) FILTER (w) AS median_taxi_out_winter_min, median(taxi_out_min) FILTER (NOT w) AS median_taxi_out_normal_min
FROM op GROUP BY 1, 2, 3"""

BLOCKS["air"] = """
SELECT event_id || '_' || airport_code || '_' || airline_group AS airline_storm_id, event_id, airport_code, airline_group,
       ifnull(departures_before, 0) AS departures_before, ifnull(cancelled_before, 0) AS cancelled_before,
       ifnull(departures_during, 0) AS departures_during, ifnull(cancelled_during, 0) AS cancelled_during,
       if(departures_before > 29, cancelled_before / departures_before, NULL) AS cancel_rate_before,
       if(departures_during > 29, cancelled_during / departures_during, NULL) AS cancel_rate_during,
       ifnull(operated_winter, 0) AS operated_winter, median_delay_winter_min, median_delay_normal_min,
       if(operated_winter > 19, median_delay_winter_min - median_delay_normal_min, NULL) AS extra_delay_min,
       if(operated_winter > 19, median_taxi_out_winter_min - median_taxi_out_normal_min, NULL) AS extra_taxi_out_min
FROM aw FULL JOIN med USING (event_id, airport_code, airline_group)"""

BLOCKS["dday"] = """
SELECT event_id, airport_code, weather_date AS day, CAST(sum(scheduled_departures) AS BIGINT) AS departures,
       CAST(sum(cancelled) AS BIGINT) AS cancelled, CAST(sum(cancelled_weather) AS BIGINT) AS cancelled_weather,
       CAST(sum(cancelled_carrier) AS BIGINT) AS cancelled_carrier, CAST(sum(cancelled_nas) AS BIGINT) AS cancelled_nas,
       CAST(sum(delayed_15) AS BIGINT) AS delayed_15
FROM hrs GROUP BY 1, 2, 3"""

BLOCKS["wday"] = """
SELECT airport_code, weather_date AS day, count(*) FILTER (has_winter_precip) AS winter_hours,
       count(*) FILTER (has_thunder) AS thunder_hours, count(*) FILTER (has_rain) AS rain_hours,
       min(temp_c) AS min_temp_c, max(wind_gust_max_kmh) AS max_gust_kmh, min(visibility_min_km) AS min_visibility_km
FROM weather GROUP BY 1, 2"""

BLOCKS["aday"] = """
SELECT dst AS airport_code, CAST(scheduled_arr_ts AS DATE) AS day, count(*) AS arrivals,
       count(*) FILTER (is_diverted) AS diverted_arrivals
FROM arr WHERE dst <> 'ZZZ' GROUP BY 1, 2"""

BLOCKS["ndiv"] = """
SELECT airport_code, year(day) AS y, median(diverted_arrivals) AS normal_diverted_arrivals FROM aday GROUP BY 1, 2"""

BLOCKS["sday"] = """
SELECT event_id, airport_code, CAST(storm_onset AS DATE) - 1 AS storm_first_day,
       CAST(precip_end + to_hours(ifnull(summ.recovery_h, 72)) AS DATE) AS storm_last_day
FROM summ WHERE storm_onset IS NOT NULL"""

BLOCKS["days"] = """
SELECT d.*, storm_first_day, storm_last_day, ifnull(d.day >= storm_first_day AND d.day <= storm_last_day, false) AS in_storm,
       winter_hours, thunder_hours, rain_hours, min_temp_c, max_gust_kmh, min_visibility_km,
       ifnull(arrivals, 0) AS arrivals, ifnull(diverted_arrivals, 0) AS diverted_arrivals,
       if(departures > 0, cancelled / departures, NULL) AS rate,
       CASE WHEN cancelled < 5 THEN NULL WHEN cancelled_weather >= greatest(cancelled_carrier, cancelled_nas) THEN 'weather'
            WHEN cancelled_carrier >= cancelled_nas THEN 'carrier' ELSE 'nas' END AS reason
FROM dday d LEFT JOIN sday USING (event_id, airport_code)
LEFT JOIN wday w ON w.airport_code = d.airport_code AND w.day = d.day
LEFT JOIN aday a ON a.airport_code = d.airport_code AND a.day = d.day"""

BLOCKS["daily"] = """
SELECT md5(concat_ws('|', event_id, d.airport_code, day)) AS airport_day_id, event_id, event_name, d.airport_code, day,
       make_date(2020, month(day), day(day)) AS aligned_day, departures, cancelled, round(rate, 4) AS cancel_rate,
       cancelled_weather, cancelled_carrier, cancelled_nas, delayed_15, reason AS main_cancel_reason,
       storm_first_day, storm_last_day, in_storm AS is_storm_period,
       ifnull(NOT in_storm AND departures > 19 AND round(rate, 4) >= 0.05, false) AS is_unusual,
       CASE WHEN in_storm OR departures < 20 OR round(rate, 4) < 0.05 THEN NULL WHEN winter_hours > 0 THEN 'local snow or ice'
            WHEN thunder_hours > 0 THEN 'thunderstorms' ELSE 'weather elsewhere' END AS unusual_reason,
       winter_hours, thunder_hours, rain_hours, min_temp_c, max_gust_kmh, min_visibility_km, arrivals, diverted_arrivals,
       normal_diverted_arrivals
FROM days d JOIN ev USING (event_id) LEFT JOIN ndiv n ON n.airport_code = d.airport_code AND n.y = year(day)"""

BLOCKS["unus"] = """
SELECT d.airport_code || '_' || CAST(day AS VARCHAR) AS airport_day_id, d.event_id, d.airport_code, day AS flight_day, departures,
       cancelled, cancelled_weather, cancelled_carrier, cancelled_nas, delayed_15, storm_first_day, storm_last_day, in_storm,
       rate AS cancel_rate, winter_hours, thunder_hours, max_gust_kmh, min_visibility_km, arrivals, diverted_arrivals,
       b.r AS normal_cancel_rate, b.v AS normal_diverted_arrivals,
       NOT in_storm AND departures > 19 AND rate >= 0.05 AS is_unusual,
       CASE WHEN NOT in_storm AND departures > 19 AND rate >= 0.05 THEN
            if(winter_hours > 0, 'local snow or ice',
               if(thunder_hours > 0, 'local thunderstorms', 'weather elsewhere in the network')) END AS unusual_explanation
FROM days d LEFT JOIN (
  SELECT event_id, airport_code, median(rate) AS r, median(diverted_arrivals) AS v
  FROM days WHERE NOT in_storm AND winter_hours = 0 AND departures > 19 GROUP BY 1, 2) b
  ON b.event_id = d.event_id AND b.airport_code = d.airport_code"""

BLOCKS["kinds"] = """
SELECT airport_code, weather_date AS day, event_id, string_agg(DISTINCT weather_group, ', ' ORDER BY weather_group) AS weather,
FROM hrs WHERE weather_group <> 'none' GROUP BY 1, 2, 3"""

BLOCKS["drate"] = """
SELECT d.*, departures - cancelled AS operated, if(departures > cancelled, delayed_15 / (departures - cancelled), NULL) AS delay_rate
FROM days d WHERE event_id IS NOT NULL"""

BLOCKS["calm"] = """
SELECT event_id, airport_code, rate, delay_rate FROM drate WHERE NOT in_storm AND winter_hours = 0 AND departures > 19"""

BLOCKS["base"] = """
SELECT event_id, airport_code, r AS normal_cancel_rate, m AS normal_delay_rate, median(abs(c.delay_rate - m)) AS delay_mad,
       m + 3.0::DOUBLE * 1.4826::DOUBLE * median(abs(c.delay_rate - m)) AS delay_threshold
FROM calm c JOIN (SELECT event_id, airport_code, median(rate) AS r, median(delay_rate) AS m FROM calm GROUP BY 1, 2) q
     USING (event_id, airport_code) GROUP BY event_id, airport_code, r, m"""

BLOCKS["flagday"] = """
SELECT * FROM drate WHERE NOT in_storm AND departures > 19 AND rate >= 0.05"""

BLOCKS["wide"] = """
SELECT event_id, airport_code, count(*) FILTER (w) AS n_w, count(*) FILTER (NOT w) AS n_n,
       median(taxi_out_min) FILTER (NOT w) AS t_n, median(taxi_out_min) FILTER (w) AS t_w,
       median(dep_delay_min) FILTER (NOT w) AS d_n, median(dep_delay_min) FILTER (w) AS d_w
FROM op GROUP BY 1, 2"""

BLOCKS["bwh"] = """
SELECT event_id, airport_code, count(*) AS busy, count(*) FILTER (scheduled_departures <> cancelled) AS running
FROM hrs WHERE has_winter_precip AND scheduled_departures > 2 GROUP BY 1, 2"""

BLOCKS["rates"] = """
SELECT airport_code, airline_group, event_id, count(*) AS departures, count(*) FILTER (is_before) AS departures_before,
       count(*) FILTER (NOT is_before) AS departures_during, count(*) FILTER (is_cancelled) AS cancelled,
       count(*) FILTER (is_cancelled AND is_before) AS cancelled_before,
       count(*) FILTER (is_cancelled AND NOT is_before) AS cancelled_during,
       count(*) FILTER (is_cancelled AND cancellation_code = 'B') AS cancelled_weather,
       if(departures_before > 29, cancelled_before / departures_before, NULL) AS cancel_rate_before,
       if(departures_during > 29, cancelled_during / departures_during, NULL) AS cancel_rate_during,
       if(cancelled > 9, cancelled_weather / cancelled, NULL) AS weather_reason_share
FROM near GROUP BY 1, 2, 3"""


def _needed(text: str) -> list[str]:
    """Blocks a statement mentions, with the blocks those mention, in definition order."""
    wanted, todo = set(), [text]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in words & set(BLOCKS) - wanted:
            wanted.add(name)
            todo.append(BLOCKS[name])
    return [name for name in BLOCKS if name in wanted]


def statement(final: str) -> str:
    parts = [f"{name} AS ({BLOCKS[name]})" for name in _needed(final)]
    return f"WITH {', '.join(parts)}\n{final}" if parts else final


# Blocks of the models that checks look at, with the model's columns where they differ.
CHECKED = {
    "storm_events": ("ev", {}), "airline_groups": ("grp", {"airline_code": "carrier"}),
    "flights_clean": ("flt", {"flight_date": "d", "origin_airport": "org"}),
    "observations": ("obs", {"valid_utc": "valid_local", "report_type": "if(is_special, 'special', 'routine')"}),
    "weather_hourly": ("weather", {}), "flights": ("flt", {"scheduled_dep_ts": "sched"}), "flights_weather": ("fw", {}),
    "airport_hourly": ("hrs", {}), "storm_summary": ("summ", {}), "storm_timeline": ("tl", {}), "airline_storm": ("air", {}),
    "airport_daily": ("daily", {}), "unusual_days": ("unus", {}),
}


def count_of(check: str, model: str, column: str, allowed: Sequence[str] = (), parent: tuple[str, str] | None = None) -> str:
    """Statement that counts the violations of one declared check."""
    block, named = CHECKED[model]
    value = named.get(column, column)
    if check == "unique":
        return f"SELECT count(*) FROM (SELECT 1 FROM {block} WHERE {value} IS NOT NULL GROUP BY {value} HAVING count(*) > 1)"
    if check == "not_null":
        return f"SELECT count(*) - count({value}) FROM {block}"
    if check == "accepted_values":
        return f"SELECT count(*) FROM {block} WHERE {value} NOT IN ({', '.join(repr(x) for x in allowed)})"
    other, column_of = CHECKED[parent[0]][0], parent[1]
    return f"SELECT count(*) FROM {block} WHERE {value} IS NOT NULL AND {value} NOT IN (SELECT {column_of} FROM {other})"


ACROSS = {
    ("consistent_counts", "airport_hourly"): """SELECT count(*) FROM hrs WHERE cancelled > scheduled_departures OR delayed_15 > scheduled_departures - cancelled
        OR cancelled <> cancelled_weather + cancelled_carrier + cancelled_nas + cancelled_security""",
    ("keeps_all_departures", "airport_hourly"): "SELECT if((SELECT sum(scheduled_departures) FROM hrs) = (SELECT count(*) FROM flt), 0, 1)",
    ("complete_window", "storm_timeline"): """SELECT count(*) FROM (SELECT 1 FROM tl GROUP BY event_id, airport_code
        HAVING count(*) <> 144 OR count(DISTINCT hours_from_onset) <> 144 OR min(hours_from_onset) <> -48 OR max(hours_from_onset) <> 95)""",
}


def all_checks(rules: Mapping) -> list[tuple[str, str, str, str, str]]:
    """Check, model, column, counting statement and severity of every declared and cross-model check."""
    out = []
    for model, r in rules.items():
        out += [("unique", model, c, count_of("unique", model, c), "error") for c in r.unique]
        out += [("not_null", model, c, count_of("not_null", model, c), "warn" if c in r.warn else "error") for c in r.not_null]
        out += [("accepted_values", model, c, count_of("accepted_values", model, c, v), "error") for c, v in (r.accepted or {}).items()]
        out += [("relationships", model, c, count_of("relationships", model, c, parent=p), "error") for c, p in (r.parents or {}).items()]
    return out + [(check, model, "", sql, "error") for (check, model), sql in ACROSS.items()]
