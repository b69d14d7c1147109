"""Sources: text CSV, monthly Parquet and seed tables, all with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.config import local_frame
from nimbusops.functions import times
from nimbusops.sources import schemas


def read_csv_text(spark: SparkSession, path: str | list[str], columns: Sequence[str | Column]) -> DataFrame:
    """Named columns of a CSV with header, all as text: types never depend on the data. Other columns
    of the file are not parsed."""
    return spark.read.option("header", True).csv(path).select(*columns)


def read_flights_csv(spark: SparkSession, path: str | list[str], airports: Sequence[str], *more: Column) -> DataFrame:
    """Flight records of the given airports, cast column by column; text that is no number fails."""
    text = read_csv_text(spark, path, [*schemas.FLIGHT_COLUMNS, "_metadata.file_name", *more])
    return text.where(from_or_to(airports)).select(
        *[F.col(c).cast(t).alias(c) for c, t in schemas.FLIGHT_COLUMNS.items()],
        F.col("file_name").alias("_source_file"), *text.columns[len(schemas.FLIGHT_COLUMNS) + 1:])


def file_name(path: Column) -> Column:
    """A file's URI in the form that Hadoop and Spark's metadata agree on."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def files_of(spark: SparkSession, sources: Mapping[tuple, str], names: Mapping[str, str]) -> DataFrame:
    """The data files behind each path of a work list: `_file` and `_of`, the keys (a list of structs of the named columns and
    types) that the file was given for. Only folders are listed."""
    system, rows = None, []
    for key, path in sources.items():
        pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.globStatus(pattern) or []:
            for f in system.listStatus(found.getPath()) if found.isDirectory() else [found]:
                if f.getPath().getName()[0] not in "_.":
                    rows.append((f.getPath().toUri().toString(), *key))
    files = local_frame(spark, {"_file": "string", **names}, rows)
    return files.groupBy(file_name(F.col("_file")).alias("_file")).agg(F.collect_list(F.struct(*names)).alias("_of"))


def from_or_to(airports: Sequence[str]) -> Column:
    return F.col("Origin").isin(*airports) | F.col("Dest").isin(*airports)


def read_observations_csv(spark: SparkSession, path: str | list[str], *more: Column) -> DataFrame:
    """Report text as delivered, with 'M' and 'T' kept as data."""
    return read_csv_text(spark, path, ["station", "valid", *schemas.OBSERVATION_FIELDS, *more])


def union_reports(routine: DataFrame, special: DataFrame) -> DataFrame:
    """Both report types in one frame, labelled."""
    return routine.withColumn("report_type", F.lit(fixed.ROUTINE)).unionByName(
        special.withColumn("report_type", F.lit(fixed.SPECIAL)))


def station_observations(reports: DataFrame, stations: DataFrame, *more: str) -> DataFrame:
    """Reports with parsed UTC time, airport code and the local month of the station's zone, and more columns."""
    named = reports.join(
        stations.select(F.col("iem_station").alias("station"), F.col("code").alias("airport_code"), "timezone"), "station")
    parsed = named.withColumn("valid_utc", F.to_timestamp_ntz("valid", F.lit("yyyy-MM-dd HH:mm")))
    local = times.utc_to_local(F.col("timezone"), F.col("valid_utc"))
    return parsed.select(
        "airport_code", "station", "valid_utc", "report_type", *schemas.OBSERVATION_FIELDS,
        F.year(local).alias("year"), F.month(local).alias("month"), *more)


def of_planned_months(observations: DataFrame, plan: DataFrame) -> DataFrame:
    """Reports whose local month is on the work list, so that monthly files never overlap."""
    return observations.join(plan.select("airport_code", "year", "month"), ["airport_code", "year", "month"], "left_semi")


def read_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Monthly Parquet files of one source; partition columns are dropped."""
    return spark.read.schema(schema).parquet(path)


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST")
        .schema(schema).csv(path)
    )
