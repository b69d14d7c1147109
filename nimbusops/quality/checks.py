"""Constraint checks as queries: every check yields one row with its number of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops import fixed_values as fixed
from nimbusops.config import Params

ERROR, WARN = "error", "warn"


@dataclass(frozen=True)
class Rules:
    """Declared constraints of one model; `warn` names the not-null columns that only warn."""

    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    accepted: Mapping[str, Sequence[str]] | None = None
    parents: Mapping[str, tuple[str, str]] | None = None  # column -> (parent model, parent column)
    warn: tuple[str, ...] = ()


def _result(check: str, model: str, column: str, violations, severity: str = ERROR):
    return [F.lit(check).alias("check"), F.lit(model).alias("model"), F.lit(column).alias("column"),
            violations.cast("long").alias("violations"), F.lit(severity).alias("severity")]


def unique(df: DataFrame, model: str, column: str) -> DataFrame:
    """Keys that occur more than once."""
    return keyed_rules(df, model, Rules(unique=(column,)))


def _tests(rules: Rules) -> list[tuple[str, str, Column, str]]:
    tests = [("not_null", c, F.col(c).isNull(), WARN if c in rules.warn else ERROR) for c in rules.not_null]
    return tests + [("accepted_values", c, F.col(c).isNotNull() & ~F.col(c).isin(*allowed), ERROR)
                    for c, allowed in (rules.accepted or {}).items()]


def _rows(counted: DataFrame, results: Sequence[list[Column]]) -> DataFrame:
    return counted.select(F.inline(F.array(*[F.struct(*r) for r in results])))


def row_rules(df: DataFrame, model: str, rules: Rules) -> DataFrame:
    """All not-null and accepted-values checks of a model in one pass over it."""
    tests = _tests(rules)
    counted = df.agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad, _) in enumerate(tests)])
    return _rows(counted, [_result(name, model, c, F.col(f"_{i}"), severity) for i, (name, c, _, severity) in enumerate(tests)])


def keyed_rules(df: DataFrame, model: str, rules: Rules) -> DataFrame:
    """All unique, not-null and accepted-values checks of a model with one key, in one pass and one
    shuffle: rows are counted per key, tests with them."""
    (key,), tests = rules.unique, _tests(rules)
    per_key = df.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("_n"), *[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad, _) in enumerate(tests)])
    counted = per_key.agg(
        F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1)).alias("_repeated"),
        *[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(tests))])
    results = [_result("unique", model, key, F.col("_repeated"))]
    return _rows(counted, results + [_result(name, model, c, F.col(f"_{i}"), severity) for i, (name, c, _, severity) in enumerate(tests)])


def flight_chain(models: Mapping[str, DataFrame], rules: Mapping[str, Rules]) -> list[DataFrame]:
    """Checks of the three flight-grain models with one shuffle of their key.

    `flights` has a row per row of `flights_clean` and the same key, so both have the same repeated keys.
    `flights_weather` has a row per departure as long as its joins find one row each; so its repeated keys
    are those among departures, plus every row that it has more or less than there are departures.
    """
    clean, timed, joined = "flights_clean", "flights", "flights_weather"
    tests = {m: _tests(rules[m]) for m in (clean, timed, joined)}
    per_key = models[timed].groupBy(F.col("flight_id").alias("_key")).agg(
        F.count("*").alias("_n"), F.count_if("is_departure").alias("_d"),
        *[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad, _) in enumerate(tests[timed])])
    keys = per_key.agg(
        F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1)).alias("_repeated"),
        F.count_if(F.col("_key").isNotNull() & (F.col("_d") > 1)).alias("_among_departures"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("_departures"),
        *[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(tests[timed]))])
    rows = models[joined].agg(F.count("*").alias("_rows"), *[F.count_if(bad).alias(f"_j{i}") for i, (_, _, bad, _) in enumerate(tests[joined])])
    both = keys.unionByName(rows, allowMissingColumns=True)  # two rows, brought into one
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    changed = F.col("_among_departures") + F.abs(F.col("_rows") - F.col("_departures"))
    results = [_result("unique", clean, "flight_id", F.col("_repeated")), _result("unique", timed, "flight_id", F.col("_repeated")),
               _result("unique", joined, "flight_id", changed)]
    results += [_result(n, timed, c, F.col(f"_{i}"), sev) for i, (n, c, _, sev) in enumerate(tests[timed])]
    results += [_result(n, joined, c, F.col(f"_j{i}"), sev) for i, (n, c, _, sev) in enumerate(tests[joined])]
    return [row_rules(models[clean], clean, rules[clean]), _rows(both, results)]


def relationships(child: DataFrame, model: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows without a parent. Child keys are counted before the join, so a hot key moves once."""
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("_n"))
    orphans = keys.join(parent, keys["_key"] == parent[parent_column], "left_anti")
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n")).select(
        *_result("relationships", model, column, F.col("_n")))


def model_checks(df: DataFrame, model: str, rules: Rules, models: Mapping[str, DataFrame]) -> list[DataFrame]:
    checks = [keyed_rules(df, model, rules)] if rules.unique else [row_rules(df, model, rules)]
    return checks + parent_checks(df, model, rules, models)


def parent_checks(df: DataFrame, model: str, rules: Rules, models: Mapping[str, DataFrame]) -> list[DataFrame]:
    return [relationships(df, model, column, models[parent], parent_column)
            for column, (parent, parent_column) in (rules.parents or {}).items()]


# --- checks across models ------------------------------------------------------------------------

def inconsistent_hours(airport_hours: DataFrame) -> DataFrame:
    """Hours whose counts contradict each other."""
    reasons = sum((F.col(f"cancelled_{r}") for r in ("carrier", "nas", "security")), F.col("cancelled_weather"))
    operated = F.col("scheduled_departures") - F.col("cancelled")
    return airport_hours.where((operated < 0) | (reasons != F.col("cancelled")) | (F.col("delayed_15") > operated))


def lost_departures(airport_hours: DataFrame, flights: DataFrame) -> DataFrame:
    """One row with both totals when departures are missing from the hour grid, else none."""
    in_mart = airport_hours.agg(F.sum("scheduled_departures").alias("in_mart"))
    in_source = flights.where("is_departure").agg(F.count("*").alias("in_source"))
    totals = in_mart.unionByName(in_source, allowMissingColumns=True)
    return totals.agg(F.max("in_mart").alias("in_mart"), F.max("in_source").alias("in_source")).where(
        "in_mart <> in_source")


def incomplete_timelines(timeline: DataFrame, params: Params) -> DataFrame:
    """Event and station pairs whose window around the onset is not complete and gap-free."""
    offset = F.col("hours_from_onset")
    windows = timeline.groupBy("event_id", "airport_code").agg(
        F.count("*").alias("hours"), F.count_distinct(offset).alias("_distinct"),
        F.min(offset).alias("first_hour"), F.max(offset).alias("last_hour"))
    complete = (
        (F.col("hours") == params.hours_before + params.hours_after) & (F.col("_distinct") == F.col("hours"))
        & (F.col("first_hour") == -params.hours_before) & (F.col("last_hour") == params.hours_after - 1)
    )
    return windows.where(~complete).drop("_distinct")


def violations(bad: DataFrame, check: str, model: str) -> DataFrame:
    return bad.agg(F.count("*").alias("_n")).select(*_result(check, model, "", F.col("_n")))


# --- declared rules ------------------------------------------------------------------------------

def declared_rules(params: Params) -> dict[str, Rules]:
    groups = sorted({g for _, g, _ in fixed.AIRLINE_GROUPS} | {fixed.OTHER_GROUP})
    return {
        "storm_events": Rules(unique=("event_id",), not_null=("event_id",)),
        "airline_groups": Rules(unique=("airline_code",), not_null=("airline_code", "airline_group")),
        "flights_clean": Rules(
            unique=("flight_id",), not_null=("flight_id", "flight_date", "origin_airport", "is_cancelled"),
            accepted={"cancellation_code": tuple(fixed.CANCELLATION_REASONS)}),
        "observations": Rules(
            unique=("metar_id",), not_null=("metar_id", "airport_code", "valid_utc"),
            accepted={"airport_code": params.airports, "report_type": (fixed.ROUTINE, fixed.SPECIAL)}),
        "weather_hourly": Rules(
            unique=("weather_hour_id",), not_null=("weather_hour_id", "airport_code", "weather_hour"),
            accepted={"weather_group": fixed.WEATHER_GROUPS}),
        "flights": Rules(unique=("flight_id",), not_null=("flight_id", "scheduled_dep_ts")),
        "flights_weather": Rules(
            unique=("flight_id",), not_null=("flight_id", "event_id", "weather_hour_id"),
            accepted={"storm_period": ("before", "storm", "after")},
            parents={"event_id": ("storm_events", "event_id")}),
        "airport_hourly": Rules(unique=("airport_hour_id",), not_null=("airport_hour_id", "event_id")),
        "storm_summary": Rules(
            unique=("storm_airport_id",), not_null=("storm_airport_id", "event_id", "storm_onset"),
            warn=("storm_onset",)),
        "storm_timeline": Rules(
            unique=("airport_hour_id",), not_null=("airport_hour_id", "hours_from_onset", "storm_phase"),
            accepted={"storm_phase": ("before", "precipitation", "recovery", "normal")},
            parents={"airport_hour_id": ("airport_hourly", "airport_hour_id")}),
        "airline_storm": Rules(
            unique=("airline_storm_id",), not_null=("airline_storm_id", "airline_group"),
            accepted={"airline_group": groups}),
        "airport_daily": Rules(
            unique=("airport_day_id",), not_null=("airport_day_id", "event_id", "is_storm_period"),
            accepted={"unusual_reason": (fixed.LOCAL_WINTER, *fixed.UNUSUAL_REASONS)}),
        "unusual_days": Rules(
            unique=("airport_day_id",), not_null=("airport_day_id", "in_storm"),
            accepted={"unusual_explanation": (fixed.LOCAL_WINTER, *fixed.UNUSUAL_EXPLANATIONS)}),
    }


def cross_checks(models: Mapping[str, DataFrame], params: Params, of: str | None = None) -> list[DataFrame]:
    """The checks across models, each with the model that it belongs to; only those of one model if named."""
    results = []
    if "airport_hourly" in models and of in (None, "airport_hourly"):
        results.append(violations(inconsistent_hours(models["airport_hourly"]), "consistent_counts", "airport_hourly"))
        if "flights" in models:
            lost = lost_departures(models["airport_hourly"], models["flights"])
            results.append(violations(lost, "keeps_all_departures", "airport_hourly"))
    if "storm_timeline" in models and of in (None, "storm_timeline"):
        results.append(violations(incomplete_timelines(models["storm_timeline"], params), "complete_window", "storm_timeline"))
    return results


def run_model_checks(models: Mapping[str, DataFrame], model: str, rules: Mapping[str, Rules], params: Params) -> DataFrame:
    """The declared and cross-model checks that belong to one model; `models` has it and its parents."""
    declared = model_checks(models[model], model, rules[model], models) if model in rules else []
    results = declared + cross_checks(models, params, model)
    return reduce(DataFrame.unionByName, results) if results else models[model].limit(0).select(*_result("", "", "", F.lit(0)))


def repeated_keys(df: DataFrame, parts: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows per part and key that occurs more than once, as parts, key and n. `parts` separate keys, as a month
    does keys with a date, so only parts that are new need a look.

    Keys are counted by 64 bits of hash, combined before the shuffle; only hashes that several rows have are
    looked at as they are. A key is never made into text.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*key))
    seen = hashed.groupBy(*parts, "_hash").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*parts, "_hash")])
    suspects = hashed.join(seen.select(*[F.col(c).alias(f"_of_{c}") for c in (*parts, "_hash")]), same, "left_semi")
    return suspects.groupBy(*parts, *key).agg(F.count("*").alias("n")).where("n > 1")


def run_checks(models: Mapping[str, DataFrame], params: Params) -> DataFrame:
    """All declared and cross-model checks on the given models: check, model, column, violations, severity."""
    rules = declared_rules(params)
    chain = {"flights_clean", "flights", "flights_weather"} if {"flights_clean", "flights", "flights_weather"} <= set(models) else set()
    results = flight_chain(models, rules) if chain else []
    for name in rules:
        if name in chain:
            results += parent_checks(models[name], name, rules[name], models)
        elif name in models:
            results += model_checks(models[name], name, rules[name], models)
    results += cross_checks(models, params)
    return reduce(DataFrame.unionByName, results)


def fail_on_errors(results: DataFrame) -> None:
    """Raise when a check of severity error has violations; the result has one row per check."""
    bad = results.where((F.col("violations") > 0) & (F.col("severity") == ERROR)).collect()
    if bad:
        raise ValueError("; ".join(f"{r.model}.{r.column} {r.check}: {r.violations}" for r in bad))
