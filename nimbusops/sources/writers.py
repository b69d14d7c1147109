"""Sinks: sorted monthly Parquet with a manifest of what has landed, and CSV exports of named tables."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nimbusops.config import local_frame
from nimbusops.sources import schemas

MONTH = ("year", "month")
ROWS_PER_FILE = 20_000_000
# Folders that Spark's readers pass over: an empty file per landed part, and what is not published yet.
MANIFEST, STAGED = "_landed", "_staging"

FLIGHT_ORDER = ("FlightDate", "CRSDepTime", "Origin", "Flight_Number_Reporting_Airline")
REPORT_ORDER = ("valid_utc", "report_type")
REPORT_PARTS = ("airport_code", *MONTH)


def _write_sorted(df: DataFrame, path: str, parts: Sequence[str], order: Sequence[str]) -> None:
    """Partitioned, sorted Parquet in one pass. The rebalance brings a month together in one file when
    it is small and splits it over many tasks and files when it is big, at run time."""
    (
        df.hint("rebalance", *[F.col(p) for p in parts])
        .sortWithinPartitions(*parts, *order)
        .write.option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*parts)
        .parquet(path)
    )


def _folder(spark: SparkSession, path: str):
    """File system and Hadoop path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _values(folders: str) -> tuple:
    """Partition values out of `a=x/b=y`; numbers are returned as such."""
    texts = [unquote(f.split("=", 1)[1]) for f in folders.split("/")]
    return tuple(int(x) if x.isdigit() else x for x in texts)


def landed_parts(spark: SparkSession, path: str, parts: Sequence[str]) -> set[tuple]:
    """Parts that the manifest of a path lists; numbers are returned as such. No data file is opened."""
    system, folder = _folder(spark, f"{path}/{MANIFEST}")
    if not system.exists(folder):
        return set()
    names = [f.getPath().getName().replace(",", "/") for f in system.listStatus(folder)]
    return {_values(name) for name in names if [f.split("=")[0] for f in name.split("/")] == list(parts)}


def stage_parts(df: DataFrame, path: str, parts: Sequence[str], order: Sequence[str]) -> str:
    """Write sorted partition folders beside the landed ones of a path, where no reader sees them."""
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}"
    _write_sorted(df, staged, parts, order)
    return staged


def publish_parts(spark: SparkSession, staged: str, path: str, parts: Sequence[str], bad: Collection[tuple] = ()) -> set[tuple]:
    """Move staged partition folders to their place, except the bad ones, and enter them in the manifest; what
    is left of the staged folder is deleted.

    A part's entry is removed first and made last. So whatever stops a run, a part that is listed is
    whole, and one that is not listed is landed again by the next run, over what this one left.
    """
    pattern = "/".join([staged, *(f"{p}=*" for p in parts)])
    system, glob = _folder(spark, pattern)
    done = set()
    for status in system.globStatus(glob) or []:
        name = "/".join(str(status.getPath()).split("/")[-len(parts):])
        if _values(name) in bad:
            continue
        _, entry = _folder(spark, f"{path}/{MANIFEST}/{name.replace('/', ',')}")
        _, target = _folder(spark, f"{path}/{name}")
        system.delete(entry, False)
        system.delete(target, True)
        system.mkdirs(target.getParent())
        if not system.rename(status.getPath(), target):
            raise OSError(f"{status.getPath()} could not be moved to {target}")
        system.create(entry, True).close()
        done.add(_values(name))
    discard(spark, staged)
    return done


def discard(spark: SparkSession, staged: str) -> None:
    system, folder = _folder(spark, staged)
    system.delete(folder, True)


def _write_new(df: DataFrame, path: str, parts: Sequence[str], order: Sequence[str], force: bool) -> None:
    spark = df.sparkSession
    existing = set() if force else landed_parts(spark, path, parts)
    if existing:  # known before the source is read, a row per part
        rows = [tuple(str(x) for x in part) for part in sorted(existing)]
        there = local_frame(spark, {f"_{p}": "string" for p in parts}, rows)
        same = reduce(and_, [F.col(p).cast("string") == F.col(f"_{p}") for p in parts])
        df = df.join(there, same, "left_anti")
    publish_parts(spark, stage_parts(df, path, parts, order), path, parts)


def write_flights(flights: DataFrame, path: str, force: bool = False) -> None:
    """Flights by month, sorted by date and scheduled time. Months that exist are kept unless forced."""
    dated = flights.withColumns({"year": F.year("FlightDate"), "month": F.month("FlightDate")})
    _write_new(dated, path, MONTH, FLIGHT_ORDER, force)


def write_observations(observations: DataFrame, path: str, force: bool = False) -> None:
    """Reports by airport and local month, sorted by time and type."""
    _write_new(observations, path, REPORT_PARTS, REPORT_ORDER, force)


def empty_flights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{schemas.RAW_FLIGHTS}, year int, month int")


def empty_observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{schemas.RAW_OBSERVATIONS}, year int, month int")


def list_tables(spark: SparkSession, prefix: str = "mart_", database: str | None = None) -> list[str]:
    """Table names with the prefix in order; an error when there is none."""
    tables = spark.catalog.listTables(database, f"{prefix}*")
    names = sorted({t.name for t in tables if t.name.startswith(prefix)})
    if not names:
        raise LookupError(f"no tables named {prefix}*: build the marts first")
    return names


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> int:
    """Write a table as CSV with header; the row count is observed during the write."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    (counted.coalesce(1) if single_file else counted).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["rows"]


def export_marts(spark: SparkSession, directory: str, prefix: str = "mart_", database: str | None = None,
                 single_file: Sequence[str] = ()) -> dict[str, int]:
    """Export every table with the prefix; names in `single_file` (small marts) become one file."""
    qualified = f"{database}." if database else ""
    return {
        name: export_csv(spark.table(f"{qualified}{name}"), f"{directory}/{name}", name in single_file)
        for name in list_tables(spark, prefix, database)
    }


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df
