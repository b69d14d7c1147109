"""Lookup values that define the data model; changing one changes results."""

from datetime import date

# Stations as (code, name, city, observation station, time zone).
STATIONS = (
    ("DFW", "Dallas/Fort Worth International Airport", "Dallas-Fort Worth", "DFW", "America/Chicago"),
    ("IAH", "George Bush Intercontinental Airport", "Houston", "IAH", "America/Chicago"),
    ("AUS", "Austin-Bergstrom International Airport", "Austin", "AUS", "America/Chicago"),
    ("SAT", "San Antonio International Airport", "San Antonio", "SAT", "America/Chicago"),
)

# Event windows as (id, name, label, data start, data end, storm start, storm end).
EVENTS = (
    ("uri_2021", "Winter Storm Uri", "Uri, Feb 2021",
     date(2021, 1, 1), date(2021, 2, 28), date(2021, 2, 14), date(2021, 2, 19)),
    ("fern_2026", "Winter Storm Fern", "Fern, Jan 2026",
     date(2026, 1, 1), date(2026, 2, 28), date(2026, 1, 23), date(2026, 1, 28)),
)

# Operating carrier, marketing group, carrier name.
AIRLINE_GROUPS = (
    ("AA", "American", "American Airlines"),
    ("MQ", "American", "Envoy Air"),
    ("OH", "American", "PSA Airlines"),
    ("WN", "Southwest", "Southwest Airlines"),
    ("UA", "United", "United Airlines"),
    ("C5", "United", "CommuteAir"),
    ("EV", "United", "ExpressJet"),
    ("DL", "Delta", "Delta Air Lines"),
    ("9E", "Delta", "Endeavor Air"),
    ("NK", "Spirit", "Spirit Airlines"),
    ("F9", "Frontier", "Frontier Airlines"),
)
OTHER_GROUP = "Other"

# Cancellation codes and their meaning.
CANCELLATION_REASONS = {"A": "carrier", "B": "weather", "C": "nas", "D": "security"}

# Report types.
ROUTINE, SPECIAL = "routine", "special"

# Weather phenomena and the text that shows them in a code (Java regex).
PHENOMENA = {
    "has_freezing_rain": "FZRA|FZDZ",
    "has_ice_pellets": "PL",
    "has_snow": "SN|SG",
    "has_rain": "(?<!FZ)(RA|DZ)",
    "has_fog": "FG",
    "has_thunder": "TS",
}

# Codes about weather that is not at the station (vicinity, blowing, drifting).
NOT_AT_STATION = "^[-+]?(VC|BL|DR)"

# Rough winter pattern used for batch summaries of raw text.
ROUGH_WINTER = "FZRA|FZDZ|PL|(?<!BL)(?<!DR)SN"

# Weather groups, the most disruptive first.
WEATHER_GROUPS = ("freezing_rain", "ice_pellets", "snow", "rain", "fog", "none")

# What explains an unusual day: winter weather, thunder, anything else, in daily and report wording.
LOCAL_WINTER = "local snow or ice"
UNUSUAL_REASONS = ("thunderstorms", "weather elsewhere")
UNUSUAL_EXPLANATIONS = ("local thunderstorms", "weather elsewhere in the network")

# Unit factors.
KM_PER_MILE = 1.609344
KMH_PER_KNOT = 1.852
M_PER_FOOT = 0.3048
MM_PER_INCH = 25.4
