"""The model chain over one set of sources, with explicit staging of the tables that are read twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusops.config import Event, Params, airline_groups_frame, events_frame, validate_events
from nimbusops.operators import cleaning, hourly
from nimbusops.plans import marts
from nimbusops.session import Staging, prepare
from nimbusops.sources import schemas
from nimbusops.sources.writers import require_columns

# Models in build order and the layer each belongs to. Staging-layer models are views.
LAYERS = {
    "flights_clean": "stg",
    "observations": "stg",
    "flights": "prep",
    "weather_hourly": "prep",
    "airport_hourly": "mart",
    "flights_weather": "mart",
    "storm_summary": "mart",
    "storm_timeline": "mart",
    "airline_storm": "mart",
    "airport_daily": "mart",
    "unusual_days": "mart",
}
VIEW_NAMES = {"flights_clean": "stg_flights", "observations": "stg_metar"}

# Models that a model is built from, nearest first; a model is left out when one of them failed its checks.
PARENTS = {
    "flights_clean": (),
    "observations": (),
    "flights": ("flights_clean",),
    "weather_hourly": ("observations",),
    "airport_hourly": ("weather_hourly", "flights"),
    "flights_weather": ("flights", "weather_hourly"),
    "storm_summary": ("airport_hourly",),
    "storm_timeline": ("storm_summary", "airport_hourly"),
    "airline_storm": ("storm_summary", "flights_weather"),
    "airport_daily": ("airport_hourly", "storm_summary", "weather_hourly", "flights"),
    "unusual_days": ("airport_hourly", "storm_summary", "weather_hourly", "flights"),
}

# How models are saved: the time whose month is their partition, and the columns that rows are bucketed by. Hours
# are unique per station, so no bucket of theirs is hot; flights are not bucketed, as a station's hour may be.
SAVED_MONTH = {"weather_hourly": "weather_hour", "airport_hourly": "weather_hour", "flights": "flight_date", "flights_weather": "flight_date"}
SAVED_BUCKETS = {"weather_hourly": hourly.HOUR, "airport_hourly": hourly.HOUR}
BUCKETS = 64


def table_name(model: str) -> str:
    return VIEW_NAMES.get(model, f"{LAYERS[model]}_{model}")


class Warehouse:
    """`view(name)` is the plan of a model; `table(name)` stages it once and reads it back. Asking for a
    view stages the tables below it, so it runs jobs; the model's own rows are not computed.

    A model asks for `table` of an input that is read more than once and is far smaller than the
    raw data (hours, pairs, days), so the raw sources are scanned once per grain. Flight-grain models
    stay views: recomputing a pruned projection is cheaper than writing a second copy of the raw rows.
    """

    # lazy plans that depend on no staged table, built once
    _PLAIN = ("flights_clean", "flights", "observations", "departures")

    def __init__(self, spark: SparkSession, raw_flights: Callable[[], DataFrame],
                 raw_observations: Callable[[], DataFrame], events: Sequence[Event], params: Params,
                 airline_groups: DataFrame | None = None):
        """airline_groups: a seed of airline_code and airline_group; the default is the documented one."""
        validate_events(events, params.airports)
        self.spark = prepare(spark)
        self._raw_flights = raw_flights
        self._raw_observations = raw_observations
        self.params = params
        self.event_list = list(events)
        self.staging = Staging(spark)
        self._groups = airline_groups
        self._tables: dict[str, DataFrame] = {}
        self._registered: list[str] = []

    @cached_property
    def events(self) -> DataFrame:
        return events_frame(self.spark, self.event_list)

    @cached_property
    def airline_groups(self) -> DataFrame:
        return airline_groups_frame(self.spark) if self._groups is None else self._groups

    def view(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        build: Callable[[], DataFrame] = getattr(self, f"_{name}")
        plan = build()
        if name in self._PLAIN:
            self._tables[name] = plan
        return plan

    def table(self, name: str) -> DataFrame:
        if name in self._PLAIN:
            raise ValueError(f"{name} has the grain of the raw data and stays a view")
        if name not in self._tables:
            self._tables[name] = self.staging.write(name, self.view(name))
        return self._tables[name]

    # staging and prep layers

    def _flights_clean(self) -> DataFrame:
        return cleaning.clean_flights(require_columns(self._raw_flights(), list(schemas.FLIGHT_COLUMNS)))

    def _observations(self) -> DataFrame:
        raw = require_columns(self._raw_observations(), ["airport_code", "valid_utc", "report_type", *schemas.OBSERVATION_FIELDS])
        return cleaning.clean_observations(raw, self.params.local_timezone)

    def _flights(self) -> DataFrame:
        return cleaning.time_flights(self.view("flights_clean"), self.params)

    def _hourly_reports(self) -> DataFrame:
        return hourly.hourly_observations(self.view("observations"), self.params)

    def _hourly_observations(self) -> DataFrame:
        return self.view("hourly_reports").drop("first_month", "last_month")

    def _hour_grid(self) -> DataFrame:
        # the hourly table knows the months where it is needed anyway; the grid alone takes a scan of one column
        months = (hourly.report_months(self.table("hourly_reports"), ["airport_code"]) if "hourly_reports" in self._tables
                  else hourly.local_months(self.view("observations"), ["airport_code"]))
        return hourly.hour_grid(months, ["airport_code"], self.params.extend_grid)

    def _weather_hourly(self) -> DataFrame:
        reports = self.table("hourly_reports")
        return hourly.fill_grid(self.view("hour_grid"), reports)

    # marts

    def _hourly_departures(self) -> DataFrame:
        return hourly.hourly_departures(self.view("flights"))

    def _airport_hourly(self) -> DataFrame:
        return hourly.airport_hourly(self.view("weather_hourly"), self.view("hourly_departures"), self.events)

    def _departures(self) -> DataFrame:
        return hourly.departures_with_event(self.view("flights"), self.events)

    def _flights_weather(self) -> DataFrame:
        return hourly.flights_weather(self.view("departures"), self.table("weather_hourly"))

    def _storm_summary(self) -> DataFrame:
        return marts.storm_summary(marts.storm_response(self.table("airport_hourly"), self.events, self.params))

    def _storm_timeline(self) -> DataFrame:
        return marts.storm_timeline(self.table("airport_hourly"), self.table("storm_summary"), self.events, self.params)

    def _onset_flights(self) -> DataFrame:
        # the weather columns are not needed here, so the flight-grain weather join is left out
        grouped = marts.with_airline_group(self.view("departures"), self.airline_groups)
        return marts.onset_flights(grouped, self.table("storm_summary"), self.params)

    def _airline_windows(self) -> DataFrame:
        return marts.airline_windows(self.view("onset_flights"))

    def _group_histogram(self) -> DataFrame:
        grouped = marts.with_airline_group(self.view("flights_weather"), self.airline_groups)
        return marts.condition_histogram(grouped, marts.GROUP)

    def _station_histogram(self) -> DataFrame:
        return marts.condition_histogram(self.view("flights_weather"), marts.PAIR)

    def _winter_normal_medians(self) -> DataFrame:
        return marts.winter_normal_medians(self.view("group_histogram"))

    def _airline_storm(self) -> DataFrame:
        self.table("weather_hourly")
        return marts.airline_storm(self.view("airline_windows"), self.view("winter_normal_medians"), self.params)

    def _storm_days(self) -> DataFrame:
        return marts.storm_days(self.table("storm_summary"), self.params)

    def _daily_weather(self) -> DataFrame:
        return marts.daily_weather(self.table("weather_hourly"))

    def _daily_arrivals(self) -> DataFrame:
        return marts.daily_arrivals(self.view("flights"))

    def _daily_departures(self) -> DataFrame:
        return marts.daily_departures(self.table("airport_hourly"))

    def _airport_daily(self) -> DataFrame:
        self.table("weather_hourly")
        return marts.airport_daily(
            self.view("daily_departures"), self.view("storm_days"), self.view("daily_weather"),
            self.table("daily_arrivals"), self.events, self.params)

    def _unusual_days(self) -> DataFrame:
        self.table("weather_hourly")
        return marts.unusual_days(
            self.view("daily_departures"), self.view("storm_days"), self.view("daily_weather"),
            self.view("daily_arrivals"), self.params)

    # full build

    def register(self, models: Sequence[str] = tuple(LAYERS), prefix: str = "") -> list[str]:
        """Build models once and register them for SQL under their layer names, behind a prefix that keeps
        them apart from other views of the session. A view that this warehouse did not make is not replaced."""
        names = [f"{prefix}{table_name(model)}" for model in models]
        views = {t.name for t in self.spark.catalog.listTables() if t.isTemporary} - set(self._registered)
        if taken := sorted(views & {name.lower() for name in names}):
            raise ValueError(f"views of these names exist: {taken}; choose a prefix")
        for model, name in zip(models, names, strict=True):
            self.built(model).createOrReplaceTempView(name)
            self._registered.append(name)
        return names

    def unregister(self) -> None:
        """Drop the views that `register` made. Frames that SQL made from them stay valid."""
        for name in self._registered:
            self.spark.catalog.dropTempView(name)
        self._registered.clear()

    def reset(self) -> None:
        """Forget all built models and remove what was staged; what is built next reads the sources again."""
        self._tables.clear()
        self.staging.remove()
        self.staging = Staging(self.spark)

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, *_) -> None:
        """Views and staged tables end with the block; saved tables stay."""
        self.unregister()
        self.staging.remove()

    def built(self, model: str) -> DataFrame:
        """Models of raw grain are views; everything smaller is staged."""
        return self.view(model) if model in (*self._PLAIN, "flights_weather") else self.table(model)

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def seeds(self) -> dict[str, DataFrame]:
        return {"storm_events": self.events, "airline_groups": self.airline_groups}

    def models(self) -> dict[str, DataFrame]:
        """All models and seeds by name, for checks."""
        return {model: self.built(model) for model in LAYERS} | self.seeds()

    def save(self, database: str, prefix: str = "", buckets: int = BUCKETS) -> None:
        """Rebuild all models from the sources: prep and mart models become catalog tables of a database,
        staging models views behind the prefix. May be called again, which replaces the tables."""
        self.reset()
        for model in LAYERS:
            self.save_model(model, database, prefix, buckets)

    def save_model(self, model: str, database: str, prefix: str = "", buckets: int = BUCKETS) -> DataFrame:
        """Save one model; models that are built later read what was saved.

        Hour tables are bucketed by station and hour and sorted in that order, so joins and windows on these
        columns take them as they lie. With the month as partition, what names a range of `saved_month` reads only these folders.
        """
        if LAYERS[model] == "stg":
            self.register([model], prefix)
            return self.view(model)
        df, name = self.view(model), f"{database}.{table_name(model)}"
        keys, parts = list(SAVED_BUCKETS.get(model, ())), []
        if model in SAVED_MONTH:
            df, parts = df.withColumn("saved_month", F.trunc(SAVED_MONTH[model], "MM")), ["saved_month"]
        if keys:  # a task writes a bucket, so that there is one file of it per month
            written = df.repartition(buckets, *keys).sortWithinPartitions(*parts, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        else:
            written = (df.hint("rebalance", "saved_month") if parts else df).write
        (written.partitionBy(*parts) if parts else written).mode("overwrite").saveAsTable(name)
        self._tables[model] = self.spark.table(name).drop(*parts)
        return self._tables[model]
