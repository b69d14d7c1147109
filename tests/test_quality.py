import pytest

from nimbusops import adapters
from nimbusops.plans.warehouse import Warehouse
from nimbusops.quality import checks


def violations(frame):
    return {(r.check, r.column): r.violations for r in frame.collect()}


def test_row_rules_and_unique(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "z")], "k string, v string")
    rules = checks.Rules(unique=("k",), not_null=("k", "v"), accepted={"v": ("x", "y")}, warn=("v",))
    (found,) = checks.model_checks(frame, "m", rules, {})
    assert violations(found) == {("unique", "k"): 1, ("not_null", "k"): 1, ("not_null", "v"): 1, ("accepted_values", "v"): 1}
    assert {r.column: r.severity for r in found.where("check = 'not_null'").collect()} == {"k": "error", "v": "warn"}
    assert violations(checks.unique(frame.where("false"), "m", "k")) == {("unique", "k"): 0}


def test_flight_chain_counts_repeated_keys_once(spark):
    clean = spark.createDataFrame([("a", None), ("a", "A"), ("b", "Z"), ("c", "A")], "flight_id string, code string")
    flights = clean.select("flight_id", (clean.code == "A").alias("is_departure"))
    joined = clean.where("code = 'A'").union(clean.where("flight_id = 'c'"))
    rules = {m: checks.Rules(unique=("flight_id",), not_null=("flight_id",)) for m in ("flights", "flights_weather")}
    rules["flights_clean"] = checks.Rules(unique=("flight_id",), not_null=("code",), accepted={"code": ("A",)})
    models = {"flights_clean": clean, "flights": flights.fillna(False), "flights_weather": joined}
    got = {(r.model, r.check, r.column): r.violations for part in checks.flight_chain(models, rules) for r in part.collect()}
    assert got == {("flights_clean", "unique", "flight_id"): 1, ("flights", "unique", "flight_id"): 1,
                   ("flights_weather", "unique", "flight_id"): 1, ("flights_clean", "not_null", "code"): 1,
                   ("flights_clean", "accepted_values", "code"): 1, ("flights", "not_null", "flight_id"): 0,
                   ("flights_weather", "not_null", "flight_id"): 0}


def test_relationships_count_rows(spark):
    child = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("b",)], "id string")
    assert violations(checks.relationships(child, "m", "k", parent, "id")) == {("relationships", "k"): 2}
    assert violations(checks.relationships(child.where("k = 'b'"), "m", "k", parent, "id")) == {("relationships", "k"): 0}


def test_only_errors_fail(spark):
    rules = checks.Rules(not_null=("v",), warn=("v",))
    frame = spark.createDataFrame([(None,)], "v string")
    checks.fail_on_errors(checks.row_rules(frame, "m", rules))
    with pytest.raises(ValueError, match="m.v not_null: 1"):
        checks.fail_on_errors(checks.row_rules(frame, "m", checks.Rules(not_null=("v",))))


def test_whole_build_passes_its_checks(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    wh = Warehouse(spark, lambda: adapters.raw_flights(events), lambda: adapters.raw_observations(events),
                   adapters.EVENTS, adapters.PARAMS)
    results = {(r.model, r.check, r.column): r.violations for r in checks.run_checks(wh.models(), adapters.PARAMS).collect()}
    assert len(results) == 60
    found = {k: v for k, v in results.items() if v}
    # the local months reach beyond the event windows, and so do the last day's flights
    assert set(found) == {("airport_hourly", "not_null", "event_id"), ("flights_weather", "not_null", "event_id"),
                          ("airline_storm", "not_null", "airline_storm_id")}
    # three stations have reports of 31 December, all four of the last two days of January
    assert found["airport_hourly", "not_null", "event_id"] == 3 * 24 * 31 + 4 * 24 * 2


def test_save_replaces_and_reset_rebuilds(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300")
    wh = Warehouse(spark, lambda: adapters.raw_flights(events), lambda: adapters.raw_observations(events), adapters.EVENTS, adapters.PARAMS)
    spark.sql("CREATE DATABASE saved_models_test")
    try:
        wh.save("saved_models_test")
        first = spark.table("saved_models_test.prep_flights").count()
        wh.save("saved_models_test")
        assert spark.table("saved_models_test.prep_flights").count() == first == 300
        assert spark.table("stg_flights").count() == 300
    finally:
        wh.unregister()
        spark.sql("DROP DATABASE saved_models_test CASCADE")
    with pytest.raises(ValueError, match="missing columns"):
        Warehouse(spark, lambda: events, lambda: events, adapters.EVENTS, adapters.PARAMS).view("flights_clean")
