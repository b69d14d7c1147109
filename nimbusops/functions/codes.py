"""Present-weather codes: which of them count, and what they say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.functions.values import first_label

WINTER_FLAGS = ("has_freezing_rain", "has_ice_pellets", "has_snow")


def station_codes_text(codes: Column) -> Column:
    """Codes of a report without those about weather elsewhere; '' when nothing remains."""
    words = F.split(F.coalesce(codes, F.lit("")), " ")
    kept = F.filter(words, lambda word: (word != "") & ~word.rlike(fixed.NOT_AT_STATION))
    return F.array_join(kept, " ")


def text_flags(text: Column) -> dict[str, Column]:
    """Phenomenon flags of one report text."""
    return {flag: text.rlike(pattern) for flag, pattern in fixed.PHENOMENA.items()}


def any_text_flags(texts: Column) -> dict[str, Column]:
    """Phenomenon flags of an array of report texts: true when any of them mentions it."""
    def mentioned(pattern: str) -> Column:
        return F.exists(texts, lambda text: text.rlike(pattern))

    return {flag: mentioned(pattern) for flag, pattern in fixed.PHENOMENA.items()}


def winter_precip() -> Column:
    rain, pellets, snow = (F.col(flag) for flag in WINTER_FLAGS)
    return rain | pellets | snow


def weather_group(has_report: Column) -> Column:
    """The most disruptive phenomenon of the hour, NULL without a report."""
    *phenomena, nothing = fixed.WEATHER_GROUPS
    label = first_label([(F.col(f"has_{name}"), name) for name in phenomena], nothing)
    return F.when(has_report, label)
