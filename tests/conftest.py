import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession

from nimbusops.session import prepare
from nimbusops.sources import schemas


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


class Make:
    """Source rows with defaults; tests name only what they are about."""

    def __init__(self, spark):
        self.spark = spark

    def flights(self, *rows):
        base = {
            "FlightDate": date(2021, 2, 10), "Reporting_Airline": "AA", "Origin": "DFW", "Dest": "AUS",
            "CRSDepTime": "1000", "CRSArrTime": "1100", "DepDelay": 0.0, "TaxiOut": 10.0, "Cancelled": 0.0,
            "Diverted": 0.0, "Distance": 100.0,
        }
        data = [{**base, "Flight_Number_Reporting_Airline": i + 1, **row} for i, row in enumerate(rows)]
        names = [c.split()[0] for c in schemas.RAW_FLIGHTS.split(", ")]
        return self.spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schemas.RAW_FLIGHTS)

    def reports(self, *rows):
        base = {"airport_code": "DFW", "station": "DFW", "report_type": "routine", "valid_utc": datetime(2021, 2, 10, 10, 53)}
        data = [{**{f: "M" for f in schemas.OBSERVATION_FIELDS}, **base, **row} for row in rows]
        names = [c.split()[0] for c in schemas.RAW_OBSERVATIONS.split(", ")]
        return self.spark.createDataFrame([tuple(d[n] for n in names) for d in data], schemas.RAW_OBSERVATIONS)


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)
