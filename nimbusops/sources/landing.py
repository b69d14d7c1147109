"""Landing jobs: find the months that are missing, read only their files, write them sorted beside the
landed ones, check them there and publish those that pass.

A run makes one job of all missing months. What is there already is known from the manifest, so nothing
of a month that is not wanted is read, and a month that failed is missing for the next run. Every row
belongs to the month its file was asked for (several, if a file serves several), so files that reach
over a month's ends need no comparison of rows, and rows that a file repeats stay.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusops.config import Event, Station, local_frame, stations_frame
from nimbusops.sources import planning, readers, writers

Month = tuple[int, int]
MONTH_TYPES = {"year": "int", "month": "int"}


def _airports_by_month(events: Sequence[Event]) -> dict[Month, set[str]]:
    wanted: dict[Month, set[str]] = {}
    for event in events:
        for month in event.months():
            wanted.setdefault(month, set()).update(event.airports)
    return wanted


def _with_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with `_of`, the keys that their file (column `file_path`) was given for. A row per file is joined; a
    file that came up after the folders were listed is an error."""
    joined = rows.withColumn("_file", readers.file_name(F.col("file_path"))).join(files, "_file", "left")
    unlisted = F.raise_error(F.concat(F.lit("not on the work list: "), F.col("file_path")))
    return joined.withColumn("_of", F.when(F.col("_of").isNull(), unlisted).otherwise(F.col("_of"))).drop("_file", "file_path")


def land_flights(spark: SparkSession, source: Callable[[int, int], str], path: str, events: Sequence[Event],
                 force: bool = False) -> tuple[DataFrame, list[str]]:
    """Land the months that events need. source: the CSV file (or folder) of a year and month.

    Returns the summary of the months that were written and warnings. Months without flights of their
    airports, and months whose file has dates outside it, are not published; an error names them, after the
    others were landed.
    """
    wanted = _airports_by_month(events)
    there = set() if force else writers.landed_parts(spark, path, writers.MONTH)
    todo = sorted(set(wanted) - there)
    if not todo:
        return planning.flight_batches(writers.empty_flights(spark)), []
    sources = {m: source(*m) for m in todo}
    airports = sorted(set().union(*(wanted[m] for m in todo)))
    text = readers.read_flights_csv(spark, sorted(set(sources.values())), airports, F.col("_metadata.file_path"))
    rows = [(y, m, a) for (y, m) in todo for a in sorted(wanted[y, m])]
    plan = local_frame(spark, {**MONTH_TYPES, "_airport": "string"}, rows).groupBy("year", "month").agg(
        F.collect_set("_airport").alias("_airports"))  # a row per month
    own = F.struct(F.year("FlightDate").alias("year"), F.month("FlightDate").alias("month"))
    # dates outside stay with the file's month, where the check finds them
    of = F.when(F.array_contains("_of", own), own).otherwise(F.col("_of")[0])
    dated = _with_files(text, readers.files_of(spark, sources, MONTH_TYPES)).withColumns({"year": of["year"], "month": of["month"]})
    kept = dated.join(plan, ["year", "month"]).where(
        F.array_contains("_airports", F.col("Origin")) | F.array_contains("_airports", F.col("Dest"))).drop("_airports", "_of")
    staged = writers.stage_parts(kept, path, writers.MONTH, writers.FLIGHT_ORDER)
    try:
        batches = planning.flight_batches(spark.read.schema(writers.empty_flights(spark).schema).parquet(staged))
        problems, warnings = planning.flight_problems(batches)
        found = {(r.year, r.month) for r in batches.select("year", "month").collect()}  # a row per month
        problems |= {m: "no flights of its airports" for m in todo if m not in found}
        writers.publish_parts(spark, staged, path, writers.MONTH, problems)
    finally:
        writers.discard(spark, staged)
    if problems:
        raise ValueError("; ".join(f"{y}-{m:02d}: {text}" for (y, m), text in sorted(problems.items())))
    return planning.flight_batches(_landed(spark, writers.empty_flights(spark), path, MONTH_TYPES, todo)), warnings


def land_observations(spark: SparkSession, source: Callable[[str, str, int, int], str], path: str, events: Sequence[Event],
                      stations: Sequence[Station], force: bool = False) -> tuple[DataFrame, list[str]]:
    """Land the airport months that events need. source: the CSV file of a station, report type, year and
    month; files may reach over the month's ends, rows are cut to the local month.

    Returns the summary of the airport months that were written and a warning for each without reports.
    """
    types = {"airport_code": "string", **MONTH_TYPES}
    of_code = {s.code: s for s in stations}
    wanted = {(code, *month) for month, codes in _airports_by_month(events).items() for code in codes}
    todo = sorted(wanted - (set() if force else writers.landed_parts(spark, path, writers.REPORT_PARTS)))
    if not todo:
        return planning.observation_batches(writers.empty_observations(spark)), []

    def read(kind: str) -> DataFrame:
        sources = {(c, y, m): source(of_code[c].iem_station, kind, y, m) for c, y, m in todo}
        text = readers.read_observations_csv(spark, sorted(set(sources.values())), F.col("_metadata.file_path"))
        return _with_files(text, readers.files_of(spark, sources, types))

    named = readers.station_observations(readers.union_reports(read("routine"), read("special")), stations_frame(spark, stations), "_of")
    kept = named.where(F.array_contains("_of", F.struct("airport_code", "year", "month"))).drop("_of")
    staged = writers.stage_parts(kept, path, writers.REPORT_PARTS, writers.REPORT_ORDER)
    try:
        found = writers.publish_parts(spark, staged, path, writers.REPORT_PARTS)
    finally:
        writers.discard(spark, staged)
    batches = planning.observation_batches(_landed(spark, writers.empty_observations(spark), path, types, todo))
    return batches, [f"{c} {y}-{m:02d}: no reports" for c, y, m in todo if (c, y, m) not in found]


def _landed(spark: SparkSession, like: DataFrame, path: str, types: Mapping[str, str], chosen: Sequence[tuple]) -> DataFrame:
    """Landed rows of the chosen parts."""
    return spark.read.schema(like.schema).parquet(path).join(local_frame(spark, dict(types), list(chosen)), list(types), "left_semi")


def read_landed(spark: SparkSession, path: str, schema: str, parts: Sequence[str] = writers.MONTH) -> DataFrame:
    """The parts that the manifest lists, and nothing that a run is replacing."""
    folders = ["/".join([path, *(f"{p}={quote(str(v), safe='')}" for p, v in zip(parts, part, strict=True))])
               for part in sorted(writers.landed_parts(spark, path, parts))]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)
