import re

import pytest
from pyspark.sql import functions as F

from nimbusops import adapters
from nimbusops.operators import hourly
from nimbusops.plans import build
from nimbusops.plans.warehouse import LAYERS, Warehouse
from nimbusops.quality import checks
from nimbusops.session import Staging, scoped, staging_root


@pytest.fixture
def wh(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 400")
    with Warehouse(spark, lambda: adapters.raw_flights(events), lambda: adapters.raw_observations(events),
                   adapters.EVENTS, adapters.PARAMS) as made:
        yield made


def test_an_error_holds_back_descendants_only(wh):
    rules = {"weather_hourly": checks.Rules(accepted={"weather_group": ("none",)}),
             "flights": checks.Rules(not_null=("flight_id", "dep_delay_min"), warn=("dep_delay_min",))}
    made = []
    outcomes = {o.model: o for o in build.checked_build(wh, rules, lambda m: made.append(m) or wh.built(m))}
    assert outcomes["weather_hourly"].status == build.FAILED and outcomes["weather_hourly"].errors == ("accepted_values weather_group",)
    assert outcomes["flights"].status == build.BUILT and outcomes["flights"].warnings == ("not_null dep_delay_min",)
    held = {m: o.because_of for m, o in outcomes.items() if o.status == build.HELD_BACK}
    assert held == dict.fromkeys(set(LAYERS) - {"flights_clean", "observations", "flights", "weather_hourly"}, "weather_hourly")
    assert made == ["flights_clean", "observations", "flights", "weather_hourly"]
    with pytest.raises(ValueError, match="weather_hourly: accepted_values weather_group"):
        build.fail_on_errors(list(outcomes.values()))


def test_a_whole_build_without_errors(wh):
    outcomes = build.checked_build(wh, {"storm_summary": checks.Rules(not_null=("event_id",))})
    assert [o.model for o in outcomes] == list(LAYERS) and {o.status for o in outcomes} == {build.BUILT}
    build.fail_on_errors(outcomes)
    assert build.outcome_frame(wh, outcomes).count() == len(LAYERS)


def shuffles(plan):
    return plan._jdf.queryExecution().executedPlan().toString()


def test_saved_hours_join_as_they_lie(spark, wh):
    spark.sql("CREATE DATABASE laid_out")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        wh.save_model("weather_hourly", "laid_out", buckets=8)
        wh.save_model("airport_hourly", "laid_out", buckets=8)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        weather, hours = spark.table("laid_out.prep_weather_hourly"), spark.table("laid_out.mart_airport_hourly")
        both = weather.join(hours, list(hourly.HOUR))
        assert "Exchange" not in shuffles(both) and both.count() == weather.count()
        departures = hourly.hourly_departures(wh.view("flights"))
        joined = shuffles(weather.join(departures, list(hourly.HOUR), "left"))  # J02
        # only the aggregation of the departures shuffles; its result meets the hours where they lie
        assert joined.count("Exchange") == 1 and re.search(r"Exchange hashpartitioning\(origin_airport", joined)
        timed = wh.view("flights").where("is_departure").join(  # J04
            weather.select(F.col("airport_code").alias("origin_airport"), F.col("weather_hour").alias("scheduled_dep_hour"), "weather_hour_id"),
            ["origin_airport", "scheduled_dep_hour"], "left")
        assert shuffles(timed).count("Exchange") == 1 and re.search(r"Exchange hashpartitioning\(origin_airport", shuffles(timed))
        january = weather.where("saved_month = date'2024-01-01'")
        assert re.search(r"PartitionFilters: \[isnotnull\(saved_month\S*\), \(saved_month", shuffles(january))
        assert 0 < january.count() < weather.count() and {r[0] for r in january.select(F.month("weather_hour")).distinct().collect()} == {1}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sql("DROP DATABASE laid_out CASCADE")


def test_views_of_others_are_not_replaced(spark, wh):
    spark.range(1).createOrReplaceTempView("stg_flights")
    try:
        with pytest.raises(ValueError, match="stg_flights"):
            wh.register(["flights_clean"])
        assert wh.register(["flights_clean"], "mine_") == ["mine_stg_flights"]
        assert wh.register(["flights_clean"], "mine_")  # its own may be replaced
        wh.unregister()
        assert spark.table("stg_flights").count() == 1
    finally:
        spark.catalog.dropTempView("stg_flights")


def folders(spark):
    from pathlib import Path

    return set(Path(staging_root(spark)).iterdir())


def test_nothing_is_left_but_the_result(spark):
    import __spark_entry__ as entry

    before = folders(spark)
    result = entry.queries()["storm_summary"](spark, "/root/testdata/sf0.001")
    (left,) = folders(spark) - before
    assert [p.name for p in left.iterdir()] == ["result"] and result.count() == 8
    lazy = scoped(spark, lambda: spark.range(3))
    assert lazy.count() == 3 and "parquet" not in shuffles(lazy).lower()
    before = folders(spark)
    with Staging(spark) as staging:
        staging.write("a", spark.range(3))
        staging.write("b", spark.range(3))
        staging.drop("a")
        assert [p.name for p in (folders(spark) - before).pop().iterdir()] == ["b"]
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError):
        scoped(spark, lambda: Staging(spark).write("t", spark.range(1 // 0)))


def test_repeated_keys(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "a", 2), (2, "a", None), (2, "b", 1), (2, "b", 1), (2, "b", 1), (None, "c", 1), (None, "c", 1)]
    df = spark.createDataFrame(rows, "month int, k string, v int")
    got = {tuple(r) for r in checks.repeated_keys(df, ["month"], ["k", "v"]).collect()}
    assert got == {(1, "a", None, 2), (2, "b", 1, 3), (None, "c", 1, 2)}
    assert checks.repeated_keys(df.distinct(), ["month"], ["k", "v"]).count() == 0
