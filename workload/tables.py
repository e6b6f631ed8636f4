"""The raw tables and models of one test directory, each built when first used."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from noonwatt.operators import scoring
from noonwatt.plans import marts, staging
from noonwatt.sources.tables import write_table
from workload import adapters


class Tables:
    zones: tuple[str, ...] = ("DE",)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    def stored(self, name: str) -> DataFrame:
        """A model written to the shared folder and read back, for queries that read
        it several times. The models are tables; here only these queries need one."""
        key = f"__stored_{name}"
        if key not in self.__dict__:
            self.__dict__[key] = write_table(getattr(self, name), self.spark, name)
        return self.__dict__[key]

    def __getattr__(self, name: str) -> DataFrame:
        maker = getattr(adapters, name, None)
        if maker is None or name.startswith("_"):
            raise AttributeError(name)
        frame = maker(self.spark, self.sf_dir)
        self.__dict__[name] = frame
        return frame

    def keep(self, df: DataFrame) -> DataFrame:
        return write_table(df, self.spark, "part")

    @cached_property
    def raw_household(self):
        return adapters.raw_household(self.spark, self.sf_dir, self.keep)

    @cached_property
    def stg_price(self):
        return staging.price(self.raw_price)

    @cached_property
    def price_hourly(self):
        return staging.price_hourly_mean(self.raw_price)

    @cached_property
    def stg_generation(self):
        return staging.generation(self.raw_public_power)

    @cached_property
    def stg_tso(self):
        return staging.operator_forecast(self.raw_day_ahead_forecast)

    @cached_property
    def stg_capacity(self):
        return staging.capacity(self.raw_capacity_types)

    @cached_property
    def event_capacity(self):
        return staging.capacity(self.raw_event_capacity)

    @cached_property
    def monthly_capacity(self):
        return staging.capacity(self.raw_installed_power)

    @cached_property
    def stg_solar_daily(self):
        return staging.solar_output(self.stored("daily_generation"), self.monthly_capacity)

    @cached_property
    def stg_solar(self):
        return staging.solar_output(self.stored("stg_generation"), self.event_capacity)

    @cached_property
    def stg_weather(self):
        return staging.weather(self.raw_weather)

    @cached_property
    def stg_weather_national(self):
        return staging.weather_national(self.stg_weather)

    @cached_property
    def mart(self):
        return marts.solar_features(
            self.stg_solar, self.stg_weather_national, self.stg_tso, store=self.keep
        )

    @cached_property
    def frame(self):
        return marts.modelling_rows(self.mart)

    @cached_property
    def latest_prediction(self):
        return scoring.latest_issues(self.prediction_log)

    @cached_property
    def metered(self):
        return staging.meter_energy(self.stored("raw_household"))

    @cached_property
    def stg_household(self):
        return staging.household(self.stored("raw_household"), store=self.keep)

    @cached_property
    def stg_household_load(self):
        return staging.household_load(self.stg_household)

    @cached_property
    def mart_household(self):
        return marts.household_features(self.stg_household_load, store=self.keep)
