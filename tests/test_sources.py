from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from nimbusops.config import (Event, default_events, default_stations, select_events, stations_frame, validate_events)
from nimbusops.session import Staging, staging_root
from nimbusops.sources import landing, planning, readers, schemas, writers

EVENT = Event("e", "Event", "E", date(2020, 12, 5), date(2021, 2, 28), date(2021, 2, 8), date(2021, 2, 10), ("DFW",))


def test_months_cross_the_year(spark):
    assert EVENT.months() == [(2020, 12), (2021, 1), (2021, 2)]
    plan = planning.plan_airport_months(spark, [EVENT, Event(**{**EVENT.__dict__, "event_id": "f", "airports": ("DFW", "IAH")})])
    assert sorted(map(tuple, plan.collect())) == [(a, y, m) for a in ("DFW", "IAH") for y, m in EVENT.months()]


@pytest.mark.parametrize("change, message", [
    ({"storm_end": date(2021, 3, 1)}, "out of order"), ({"airports": ("XXX",)}, "no such station"),
    ({"data_start": "2021-01-01"}, "not of type date"), ({"data_start": datetime(2021, 1, 1)}, "not of type date"),
])
def test_bad_events(change, message):
    with pytest.raises(ValueError, match=message):
        validate_events([Event(**{**EVENT.__dict__, **change})], ["DFW"])


def test_overlapping_windows_are_rejected():
    with pytest.raises(ValueError, match="in both e and f"):
        validate_events([EVENT, Event(**{**EVENT.__dict__, "event_id": "f", "data_start": date(2021, 2, 1)})], ["DFW"])


def test_select_events():
    events = default_events()
    validate_events(events, [s.code for s in default_stations()])
    assert select_events(events) == events
    assert [e.event_id for e in select_events(events, ["fern_2026"])] == ["fern_2026"]
    with pytest.raises(ValueError, match="no event has the id none"):
        select_events(events, ["none"])


def flights_csv(make, path, *rows):
    raw = make.flights(*rows).drop("_source_file").withColumn("Extra", F.lit("x"))
    columns = raw.columns
    raw.select(columns[-1], *columns[:-1]).coalesce(1).write.option("header", True).csv(str(path))
    return str(path)


def test_flight_landing(spark, make, tmp_path):
    source = flights_csv(
        make, tmp_path / "csv", {"CRSDepTime": "0605"}, {"Origin": "LAX", "Dest": "DFW"}, {"Origin": "LAX", "Dest": "JFK"},
        {"FlightDate": date(2021, 3, 1), "DepDelay": None})
    landed = readers.read_flights_csv(spark, source, ["DFW"])
    assert [f.dataType.simpleString() for f in landed.schema][:26] == list(schemas.FLIGHT_COLUMNS.values())
    out = str(tmp_path / "flights")
    writers.write_flights(landed, out)
    back = readers.read_raw(spark, out, schemas.RAW_FLIGHTS)
    rows = {r.Flight_Number_Reporting_Airline: r for r in back.collect()}
    assert set(rows) == {1, 2, 4}
    assert rows[1].CRSDepTime == "0605" and rows[4].DepDelay is None and rows[1]._source_file.endswith(".csv")
    assert sorted(p.name for p in (tmp_path / "flights").glob("year=2021/*")) == ["month=2", "month=3"]


def test_existing_months_are_skipped_unless_forced(spark, make, tmp_path):
    out = str(tmp_path / "flights")

    def count():
        return {r.month: r["count"] for r in spark.read.parquet(out).groupBy("month").count().collect()}

    march = {"FlightDate": date(2021, 3, 1)}
    writers.write_flights(make.flights({}), out)
    writers.write_flights(make.flights({}, {}, march), out)
    assert count() == {2: 1, 3: 1}
    writers.write_flights(make.flights({}, {}), out, force=True)
    assert count() == {2: 2, 3: 1}


def test_strict_casts(spark, make, tmp_path):
    source = str(tmp_path / "bad")
    make.flights({}).withColumn("DepDelay", F.lit("late")).write.option("header", True).csv(source)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_flights_csv(spark, source, ["DFW"]).collect()


def test_observation_landing(spark, tmp_path):
    path = tmp_path / "obs.csv"
    header = ["station", "valid", *schemas.OBSERVATION_FIELDS]
    line = {f: "M" for f in schemas.OBSERVATION_FIELDS} | {"station": "DFW", "tmpf": "30.0", "p01i": "T", "wxcodes": "-SN"}
    times = ["2021-02-01 05:59", "2021-02-01 06:00", "2021-03-01 05:59", "2021-03-01 06:00"]
    path.write_text("\n".join([",".join(header)] + [",".join({**line, "valid": t}[h] for h in header) for t in times]))
    routine = readers.read_observations_csv(spark, str(path))
    both = readers.union_reports(routine, routine.limit(0))
    named = readers.station_observations(both, stations_frame(spark, default_stations()))
    plan = planning.month_plan(
        spark.createDataFrame([("DFW", date(2021, 2, 1), date(2021, 2, 28))], "airport_code string, a date, b date"),
        ["airport_code"], "a", "b")
    kept = readers.of_planned_months(named, plan)
    assert sorted(r.valid_utc for r in kept.collect()) == [datetime(2021, 2, 1, 6), datetime(2021, 3, 1, 5, 59)]
    out = str(tmp_path / "metar")
    writers.write_observations(kept, out)
    back = readers.read_raw(spark, out, schemas.RAW_OBSERVATIONS.split(", ", 1)[1]).collect()
    assert {(r.tmpf, r.p01i, r.wxcodes, r.dwpf, r.report_type) for r in back} == {("30.0", "T", "-SN", "M", "routine")}
    batch = planning.observation_batches(kept).collect()[0]
    assert (batch.routine, batch.special, batch.min_tmpf, batch.winter_reports, batch.expected_hours) == (2, 0, 30.0, 2, 672)


def test_flight_batches(spark, make):
    flights = make.flights({"Cancelled": 1.0}, {"Cancelled": 1.0, "CancellationCode": "B"}, {}).withColumns(
        {"year": F.lit(2021), "month": F.lit(2)})
    assert planning.check_flight_batches(planning.flight_batches(flights)) == ["2021-02: 1 cancelled flights without code"]
    with pytest.raises(ValueError, match="outside"):
        planning.check_flight_batches(planning.flight_batches(flights.withColumn("month", F.lit(3))))


def test_seed(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("event_id,event_name,data_start,data_end,storm_start,storm_end\n"
                    "e,Event,2021-01-01,2021-02-28,2021-02-14,2021-02-19\n")
    row = readers.read_seed(spark, str(path), schemas.STORM_EVENTS).collect()[0]
    assert row.storm_end == date(2021, 2, 19)


def test_export(spark, tmp_path):
    for name in ("mart_b", "mart_a", "other"):
        spark.range(3).createOrReplaceTempView(name)
    try:
        assert writers.list_tables(spark, "mart_")[:2] == ["mart_a", "mart_b"]
        written = writers.export_marts(spark, str(tmp_path / "out"), "mart_a")
        assert written == {"mart_a": 3}
        assert spark.read.option("header", True).csv(str(tmp_path / "out" / "mart_a")).columns == ["id"]
    finally:
        for name in ("mart_b", "mart_a", "other"):
            spark.catalog.dropTempView(name)
    with pytest.raises(LookupError):
        writers.list_tables(spark, "nothing_")


def test_required_columns(spark):
    assert writers.require_columns(spark.range(1), ["id"]).columns == ["id"]
    with pytest.raises(ValueError, match="missing"):
        writers.require_columns(spark.range(1), ["id", "x"])


def test_staged_tables_cut_the_lineage(spark):
    staged = Staging(spark).write("t", spark.range(5))
    assert staged.count() == 5 and staged.inputFiles()[0].startswith(f"file://{staging_root(spark)}")


def test_landed_parts_come_from_the_manifest(spark, make, tmp_path):
    path = str(tmp_path / "flights")
    assert writers.landed_parts(spark, path, writers.MONTH) == set()
    writers.write_flights(make.flights({}, {"FlightDate": date(2021, 3, 1)}), path)
    assert writers.landed_parts(spark, path, writers.MONTH) == {(2021, 2), (2021, 3)}
    writers.write_flights(make.flights({}, {}, {"FlightDate": date(2021, 4, 1)}), path)
    counts = {(r.year, r.month): r["count"] for r in spark.read.parquet(path).groupBy("year", "month").count().collect()}
    assert counts == {(2021, 2): 1, (2021, 3): 1, (2021, 4): 1}
    writers.write_flights(make.flights({}, {}), path, force=True)
    assert spark.read.parquet(path).where("month = 2").count() == 2


FEBRUARY = Event("e", "Event", "E", date(2021, 2, 5), date(2021, 2, 28), date(2021, 2, 8), date(2021, 2, 10), ("DFW",))
MARCH = Event("f", "Event", "F", date(2021, 3, 1), date(2021, 3, 8), date(2021, 3, 2), date(2021, 3, 3), ("IAH",))


def test_flight_landing_job(spark, make, tmp_path):
    files = {(2021, 2): flights_csv(make, tmp_path / "feb", {}, {"Origin": "IAH", "Dest": "SAT"}, {"Cancelled": 1.0}),
             (2021, 3): flights_csv(make, tmp_path / "mar", {"FlightDate": date(2021, 3, 2), "Origin": "IAH", "Dest": "XYZ"},
                                    {"FlightDate": date(2021, 3, 2), "Dest": "XYZ"})}
    read, path = [], str(tmp_path / "landed")

    def source(year, month):
        read.append((year, month))
        return files[year, month]

    batches, warnings = landing.land_flights(spark, source, path, [FEBRUARY])
    assert [(r.year, r.month, r.flights) for r in batches.collect()] == [(2021, 2, 2)]
    assert warnings == ["2021-02: 1 cancelled flights without code"]
    batches, _ = landing.land_flights(spark, source, path, [FEBRUARY, MARCH])
    assert [(r.month, r.flights) for r in batches.collect()] == [(3, 1)] and read == [(2021, 2), (2021, 3)]
    assert landing.land_flights(spark, source, path, [FEBRUARY, MARCH])[0].count() == 0 and len(read) == 2
    assert landing.land_flights(spark, source, path, [FEBRUARY], force=True)[0].count() == 1 and len(read) == 3
    files[2021, 3] = flights_csv(make, tmp_path / "none", {"FlightDate": date(2021, 3, 2), "Origin": "SAT", "Dest": "XYZ"})
    with pytest.raises(ValueError, match="no flights"):
        landing.land_flights(spark, source, str(tmp_path / "other"), [MARCH])


def landed(spark, path, parts=writers.MONTH, schema=schemas.RAW_FLIGHTS + ", year int, month int"):
    return {tuple(r[:-1]): r[-1] for r in landing.read_landed(spark, path, schema, parts).groupBy(*parts).count().collect()}


def test_failed_months_are_landed_by_the_next_run(spark, make, tmp_path):
    late = {"FlightDate": date(2021, 3, 2), "Origin": "IAH", "Dest": "XYZ"}
    files = {(2021, 2): flights_csv(make, tmp_path / "feb", {}), (2021, 3): flights_csv(make, tmp_path / "bad", late, {**late, "FlightDate": date(2021, 4, 1)})}
    path, read = str(tmp_path / "landed"), []

    def source(year, month):
        read.append(month)
        return files[year, month]

    for _ in range(2):  # the failed month is not skipped, the good one is
        with pytest.raises(ValueError, match="^2021-03: dates 2021-03-02..2021-04-01 lie outside$"):
            landing.land_flights(spark, source, path, [FEBRUARY, MARCH])
        assert landed(spark, path) == {(2021, 2): 1} == {(2021, 2): spark.read.parquet(path).count()}
    files[2021, 3] = flights_csv(make, tmp_path / "good", late, late)
    landing.land_flights(spark, source, path, [FEBRUARY, MARCH])
    assert landed(spark, path) == {(2021, 2): 1, (2021, 3): 2} and read == [2, 3, 3, 3]
    files[2021, 3] = files[2021, 2]
    with pytest.raises(ValueError, match="2021-03: no flights of its airports"):  # what landed before stays
        landing.land_flights(spark, source, path, [MARCH], force=True)
    assert landed(spark, path) == {(2021, 2): 1, (2021, 3): 2}
    assert not list((tmp_path / "landed" / "_staging").iterdir())


def test_run_that_stops_while_publishing(spark, make, tmp_path, monkeypatch):
    """A month without an entry in the manifest is landed again, whatever lies in its folder."""
    path = str(tmp_path / "landed")
    writers.write_flights(make.flights({}, {"FlightDate": date(2021, 3, 1)}), path)
    (tmp_path / "landed" / "_landed" / "year=2021,month=3").unlink()
    assert writers.landed_parts(spark, path, writers.MONTH) == {(2021, 2)} and landed(spark, path) == {(2021, 2): 1}
    march = [{"FlightDate": date(2021, 3, 5)}] * 3
    writers.write_flights(make.flights({}, {}, *march), path)
    assert landed(spark, path) == {(2021, 2): 1, (2021, 3): 3}
    assert spark.read.parquet(path).count() == 4  # no row of the stopped run is left


def test_a_file_for_several_months(spark, make, tmp_path):
    quarter = flights_csv(make, tmp_path / "csv", {}, {"FlightDate": date(2021, 3, 2), "Origin": "IAH", "Dest": "XYZ"})
    landing.land_flights(spark, lambda y, m: quarter, str(tmp_path / "landed"), [FEBRUARY, MARCH])
    assert landed(spark, str(tmp_path / "landed")) == {(2021, 2): 1, (2021, 3): 1}


def test_reports_of_overlapping_files(spark, tmp_path):
    """Each report comes from the file of its own local month; one that a file repeats stays repeated."""
    header = ["station", "valid", *schemas.OBSERVATION_FIELDS]
    times = {2: ["2021-02-28 20:00", "2021-02-28 20:00", "2021-03-01 05:00", "2021-03-01 07:00"],
             3: ["2021-02-28 20:00", "2021-03-01 05:00", "2021-03-01 07:00", "2021-03-01 07:00", "2021-03-01 07:00"]}

    def source(station, kind, year, month):
        path = tmp_path / f"{station} {kind} {month}%.csv"  # characters that URIs escape
        lines = [",".join([station, t, *["M"] * len(schemas.OBSERVATION_FIELDS)]) for t in (times[month] if kind == "routine" else [])]
        path.write_text("\n".join([",".join(header), *lines]))
        return str(path)

    both = Event("e", "Event", "E", date(2021, 2, 5), date(2021, 3, 28), date(2021, 2, 8), date(2021, 2, 10), ("DFW",))
    path = str(tmp_path / "weather")
    batches, _ = landing.land_observations(spark, source, path, [both], default_stations())
    assert {(r.month, r.routine) for r in batches.collect()} == {(2, 3), (3, 3)}
    schema = schemas.RAW_OBSERVATIONS + ", year int, month int"
    assert landed(spark, path, writers.REPORT_PARTS, schema) == {("DFW", 2021, 2): 3, ("DFW", 2021, 3): 3}


def test_weather_landing_job(spark, tmp_path):
    header = ["station", "valid", *schemas.OBSERVATION_FIELDS]
    read = []

    def source(station, kind, year, month):
        read.append((station, kind, year, month))
        path = tmp_path / f"{station}-{kind}-{year}-{month}.csv"
        times = ["2021-02-01 05:59", "2021-02-01 06:00", "2021-03-01 05:59", "2021-03-01 06:00"] if kind == "routine" else []
        lines = [",".join([station, t, *["M"] * len(schemas.OBSERVATION_FIELDS)]) for t in times]
        path.write_text("\n".join([",".join(header), *lines]))
        return str(path)

    path = str(tmp_path / "weather")
    batches, warnings = landing.land_observations(spark, source, path, [FEBRUARY], default_stations())
    assert [(r.airport_code, r.year, r.month, r.routine) for r in batches.collect()] == [("DFW", 2021, 2, 2)] and not warnings
    assert len(read) == 2
    batches, _ = landing.land_observations(spark, source, path, [FEBRUARY], default_stations())
    assert batches.count() == 0 and len(read) == 2
    may = Event("m", "May", "M", date(2021, 5, 1), date(2021, 5, 8), date(2021, 5, 2), date(2021, 5, 3), ("DFW",))
    assert landing.land_observations(spark, source, path, [may], default_stations())[1] == ["DFW 2021-05: no reports"]


def test_staged_folder_can_be_removed(spark):
    staging = Staging(spark)
    path = staging.write("t", spark.range(5)).inputFiles()[0]
    staging.remove()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
