"""Work lists and batch summaries for landing data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.config import Event, local_frame
from nimbusops.functions import values


def month_plan(windows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Distinct (key, year, month) that date windows touch, both ends included."""
    months = F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("interval 1 month"))
    return windows.select(*keys, F.explode(months).alias("_month")).select(
        *keys, F.year("_month").alias("year"), F.month("_month").alias("month")).distinct()


def event_windows(spark: SparkSession, events: Sequence[Event]) -> DataFrame:
    rows = [(e.event_id, code, e.data_start, e.data_end) for e in events for code in e.airports]
    columns = {"event_id": "string", "airport_code": "string", "data_start": "date", "data_end": "date"}
    return local_frame(spark, columns, rows)


def plan_airport_months(spark: SparkSession, events: Sequence[Event]) -> DataFrame:
    """Work list of landing: one row per airport and month that any event needs."""
    return month_plan(event_windows(spark, events), ["airport_code"], "data_start", "data_end")


def invalid_windows(windows: DataFrame) -> DataFrame:
    """Windows whose storm dates do not lie in order inside the data dates, with the first problem found."""
    problem = values.first_label([
        (F.col("data_start") > F.col("storm_start"), "storm starts before the data"),
        (F.col("storm_start") > F.col("storm_end"), "storm ends before it starts"),
        (F.col("storm_end") > F.col("data_end"), "storm ends after the data"),
    ])
    return windows.withColumn("problem", problem).where("problem is not null")


def flight_batches(flights: DataFrame) -> DataFrame:
    """Validation summary per month of landed flights, in one aggregation."""
    cancelled = F.col("Cancelled") == 1
    coded = cancelled & F.col("CancellationCode").isNotNull()
    return flights.groupBy("year", "month").agg(
        F.count("*").alias("flights"),
        F.min("FlightDate").alias("first_date"),
        F.max("FlightDate").alias("last_date"),
        F.coalesce(F.sum("Cancelled").cast("int"), F.lit(0)).alias("cancelled"),
        values.count_where(coded).alias("cancelled_with_code"),
    ).withColumns({
        "dates_in_month": (F.year("first_date") == F.col("year")) & (F.month("first_date") == F.col("month"))
        & (F.year("last_date") == F.col("year")) & (F.month("last_date") == F.col("month")),
        "without_code": F.col("cancelled") - F.col("cancelled_with_code"),
    })


def flight_problems(batches: DataFrame) -> tuple[dict[tuple[int, int], str], list[str]]:
    """Months with dates outside them, and warnings for cancelled flights without code."""
    found = batches.where("not dates_in_month or without_code > 0").orderBy("year", "month").collect()  # a row per month
    wrong = {(r.year, r.month): f"dates {r.first_date}..{r.last_date} lie outside" for r in found if not r.dates_in_month}
    return wrong, [f"{r.year}-{r.month:02d}: {r.without_code} cancelled flights without code" for r in found if r.without_code > 0]


def check_flight_batches(batches: DataFrame) -> list[str]:
    """Warnings for cancelled flights without code; an error for a month with dates outside it."""
    wrong, warnings = flight_problems(batches)
    if wrong:
        raise ValueError(f"dates outside their month: {sorted(wrong)}")
    return warnings


#: The raw columns whose values tell flights apart; the date keeps keys of different months apart.
FLIGHT_KEY = ("FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin")


def observation_batches(reports: DataFrame) -> DataFrame:
    """Summary of raw reports per airport and local month; text that is no number is left out."""
    temperature = F.col("tmpf").try_cast("double")
    kind = F.col("report_type")
    hours = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1)))) * 24
    return reports.groupBy("airport_code", "year", "month").agg(
        values.count_where(kind == fixed.ROUTINE).alias("routine"),
        values.count_where(kind == fixed.SPECIAL).alias("special"),
        F.min(temperature).alias("min_tmpf"),
        F.max(temperature).alias("max_tmpf"),
        values.count_where(F.col("wxcodes").rlike(fixed.ROUGH_WINTER)).alias("winter_reports"),
    ).withColumn("expected_hours", hours)
