"""The driver's test tables as flight and observation sources.

Every row of `events` becomes one flight and one weather report, so the whole chain from raw text to
the marts runs on data that grows with the table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from nimbusops.config import Event, Params

AIRPORTS = ("AAA", "BBB", "CCC", "DDD")

PARAMS = Params(airports=AIRPORTS, local_timezone="America/Chicago", hours_after=96, implausible_precip_mm=12.0)

EVENTS = [
    Event("ev_a", "Event A", "A, early January", date(2024, 1, 1), date(2024, 1, 15),
          date(2024, 1, 10), date(2024, 1, 12), AIRPORTS),
    # the last day of the table lies in no event
    Event("ev_b", "Event B", "B, late January", date(2024, 1, 16), date(2024, 1, 29),
          date(2024, 1, 24), date(2024, 1, 25), AIRPORTS),
]

_ORIGIN = "element_at(array('AAA', 'BBB', 'CCC', 'DDD'), cast(user_id % 4 as int) + 1)"
_DEST = "element_at(array('AAA', 'BBB', 'CCC', 'DDD', 'ZZZ'), cast((user_id div 24) % 5 as int) + 1)"
_AIRLINE = "element_at(array('AA', 'MQ', 'WN', 'UA', 'DL', 'XX'), cast((user_id div 4) % 6 as int) + 1)"

# Winter weather on days 8, 10 to 12, 24 and 25; a thunderstorm on day 20; codes that are not about the station.
_CODES = """case
    when day(ts) in (8, 10, 11, 12, 24, 25) and event_type = 'error' then '-FZRA BR'
    when day(ts) in (8, 10, 11, 12, 24, 25) and event_type = 'signup' then if(event_id % 2 = 0, 'SN', 'PL')
    when event_type = 'purchase' then if(day(ts) = 20, 'TSRA', element_at(array('VCTS', 'BLSN', '-DRSN'), int(event_id % 3) + 1))
    when event_type = 'click' and event_id % 4 = 0 then 'RA'
    when event_type = 'error' and event_id % 4 = 0 then 'FG'
    when event_type in ('error', 'signup') then 'BR'
    else 'M' end"""

# Cancellations on days 11 to 13, 25 and 26 (disruption) and on days 3, 8 and 20 (unusual days).
_CANCELLED = """case
    when day(ts) in (11, 12, 13, 25, 26) then event_type in ('error', 'signup', 'click')
    when day(ts) in (3, 8, 20) then event_type = 'click'
    else value > 400 end"""

_DEPARTURE = "string(hour(ts) * 100 + minute(ts))"
# From one hour before to four hours after the departure on the destination's clock; midnight is 2400.
_ARRIVAL = "pmod(hour(ts) * 60 + minute(ts) + int(event_id % 300) - 61, 1440) + 1"


def raw_observations(events: DataFrame) -> DataFrame:
    """Weather reports as the source delivers them: text with 'M' and 'T', times in UTC."""
    return events.selectExpr(
        f"{_ORIGIN} as airport_code",
        f"{_ORIGIN} as station",
        "ts as valid_utc",
        "if(event_id % 5 = 0, 'special', 'routine') as report_type",
        "if(event_id % 11 = 0, 'M', string(int(floor(value)))) as tmpf",
        "if(event_id % 7 = 0, 'M', string(int(floor(value / 2)))) as dwpf",
        "string(event_id % 100) as relh",
        "string(event_id % 36 * 10) as drct",
        "string(event_id % 40) as sknt",
        "if(event_id % 3 = 0, string(event_id % 60 + 10), 'M') as gust",
        "string((event_id % 40 + 1) / 4) as vsby",
        "case when event_type = 'view' then 'T' when event_id % 13 = 0 then 'M' else string(event_id % 50 / 100) end as p01i",
        f"{_CODES} as wxcodes",
        "case when event_id % 19 = 0 then 'T' when event_id % 4 = 0 then string(event_id % 30 / 100) else 'M' end "
        "as ice_accretion_1hr",
        "element_at(array('FEW', 'SCT', 'BKN', 'OVC', 'M'), cast(event_id % 5 as int) + 1) as skyc1",
        "if(event_id % 6 = 0, 'M', string(event_id % 120 * 100)) as skyl1",
        f"concat_ws(' ', 'METAR', {_ORIGIN}, event_type) as metar",
    )


def raw_flights(events: DataFrame) -> DataFrame:
    """Flights with the source column names: clock text (half of it without leading zeros), numeric flags."""
    return events.selectExpr(
        "date(ts) as FlightDate",
        f"{_AIRLINE} as Reporting_Airline",
        "concat('N', string(user_id)) as Tail_Number",
        "event_id as Flight_Number_Reporting_Airline",
        f"{_ORIGIN} as Origin",
        f"{_DEST} as Dest",
        f"if(event_id % 2 = 0, {_DEPARTURE}, lpad({_DEPARTURE}, 4, '0')) as CRSDepTime",
        f"if({_CANCELLED}, null, lpad({_DEPARTURE}, 4, '0')) as DepTime",
        "if(event_id % 17 = 0, null, round(value / 3)) as DepDelay",
        "double(10 + event_id % 30) as TaxiOut",
        "string(null) as WheelsOff",
        f"lpad(string({_ARRIVAL} + 40 * (({_ARRIVAL}) div 60)), 4, '0') as CRSArrTime",
        "string(null) as ArrTime",
        "double(event_id % 45 - 10) as ArrDelay",
        f"double(int({_CANCELLED})) as Cancelled",
        f"if({_CANCELLED}, element_at(array('B', 'B', 'B', 'A', 'C'), cast(event_id % 5 as int) + 1), null) as CancellationCode",
        "double(int(event_id % 97 = 0)) as Diverted",
        "double(60 + event_id % 240) as CRSElapsedTime",
        "double(55 + event_id % 250) as ActualElapsedTime",
        "double(40 + event_id % 200) as AirTime",
        "double(100 + event_id % 1900) as Distance",
        "double(event_id % 15) as CarrierDelay",
        "double(event_id % 25) as WeatherDelay",
        "double(event_id % 10) as NASDelay",
        "double(event_id % 3) as SecurityDelay",
        "double(event_id % 20) as LateAircraftDelay",
        "'events' as _source_file",
    )
