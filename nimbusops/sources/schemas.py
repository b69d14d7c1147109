"""Declared source schemas; nothing is inferred."""

from __future__ import annotations

# Flight columns in the order of the landed files, with their types.
FLIGHT_COLUMNS = {
    "FlightDate": "date",
    "Reporting_Airline": "string",
    "Tail_Number": "string",
    "Flight_Number_Reporting_Airline": "bigint",
    "Origin": "string",
    "Dest": "string",
    "CRSDepTime": "string",
    "DepTime": "string",
    "DepDelay": "double",
    "TaxiOut": "double",
    "WheelsOff": "string",
    "CRSArrTime": "string",
    "ArrTime": "string",
    "ArrDelay": "double",
    "Cancelled": "double",
    "CancellationCode": "string",
    "Diverted": "double",
    "CRSElapsedTime": "double",
    "ActualElapsedTime": "double",
    "AirTime": "double",
    "Distance": "double",
    "CarrierDelay": "double",
    "WeatherDelay": "double",
    "NASDelay": "double",
    "SecurityDelay": "double",
    "LateAircraftDelay": "double",
}

# Report fields, which stay text because 'M' and 'T' mean something.
OBSERVATION_FIELDS = (
    "tmpf", "dwpf", "relh", "drct", "sknt", "gust", "vsby", "p01i", "wxcodes",
    "ice_accretion_1hr", "skyc1", "skyl1", "metar",
)

RAW_FLIGHTS = ", ".join(f"{c} {t}" for c, t in FLIGHT_COLUMNS.items()) + ", _source_file string"
RAW_OBSERVATIONS = (
    "airport_code string, station string, valid_utc timestamp_ntz, report_type string, "
    + ", ".join(f"{f} string" for f in OBSERVATION_FIELDS)
)

STORM_EVENTS = (
    "event_id string, event_name string, data_start date, data_end date, "
    "storm_start date, storm_end date"
)
AIRLINE_GROUPS = "airline_code string, airline_group string, carrier_name string"
