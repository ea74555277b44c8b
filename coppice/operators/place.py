"""Location features joined from a table of places."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.functions.schema import NUMERIC, quote, require
from coppice.operators.lookup import WEIGHT, KeyedTable, attach, freeze
from coppice.operators.nearest import nearest_places
from coppice.operators.steps import Fitted, Found, Needs, Step

# Attributes of the area reachable from a place, and travel times in seconds.
PLACE_ATTRIBUTES = ("area", "reachfactor", "total_pop")
PLACE_SECONDS = (60, 600, 1800, 3600)


def place_columns() -> list[str]:
    return [f"place_{attribute}_{seconds}" for attribute in PLACE_ATTRIBUTES for seconds in PLACE_SECONDS]


def latlon_flags(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    return df.withColumn("valid_place", X.valid_place(latitude, longitude))


def distinct_places(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    keys = [X.col(latitude).cast("double").alias("latitude"), X.col(longitude).cast("double").alias("longitude")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(WEIGHT))


def places_from_provider(
    places: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """Ask ``provider`` for the features of distinct places, batch by batch on the executors."""

    columns = ["latitude", "longitude", *place_columns()]

    def ask(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield provider(batch)[columns]

    return places.select("latitude", "longitude").mapInPandas(ask, ", ".join(f"{c} double" for c in columns))


@dataclass(frozen=True)
class FittedPlace(Fitted):
    latitude: str
    longitude: str
    on_missing: str
    table: KeyedTable

    @property
    def output_columns(self) -> list[str]:
        return place_columns()

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.latitude, self.longitude], NUMERIC)
        on = {"latitude": X.col(self.latitude).cast("double"), "longitude": X.col(self.longitude).cast("double")}
        values = {c: c for c in place_columns()} | {"known": "__known"}
        df = attach(df, self.table, on, values)
        if self.on_missing == "error":
            first = place_columns()[0]
            missing = F.raise_error(F.lit("a place has no entry in the table of places"))
            df = df.withColumn(first, F.when(F.col("__known"), F.col(first)).otherwise(missing))
        return df.drop("__known")


@dataclass(frozen=True)
class PlaceFeatures(Step):
    """Twelve features per (latitude, longitude) from ``places``.

    ``places`` has ``latitude``, ``longitude`` and :func:`place_columns`. A
    place without an entry is an error, or null with ``on_missing="null"``. With
    ``tolerance_m`` the nearest entry within so many metres counts, else only
    one with the very same coordinates.
    """

    latitude: str
    longitude: str
    places: DataFrame
    on_missing: str = "error"
    tolerance_m: float | None = None

    @property
    def input_columns(self) -> list[str]:
        return [self.latitude, self.longitude]

    @property
    def output_columns(self) -> list[str]:
        return place_columns()

    def needs(self, df: DataFrame) -> Needs:
        """Both coordinates as one text, which doubles survive unchanged; null if one is null."""
        require(df, [self.latitude, self.longitude], NUMERIC)
        parts = [F.col(quote(c)).cast("double").cast("string") for c in (self.latitude, self.longitude)]
        return Needs(keys={"place": F.concat(parts[0], F.lit(" "), parts[1])})

    def build(self, found: Found) -> FittedPlace:
        parts = F.split("level", " ")
        return self._joined(found.levels("place").select(
            parts[0].cast("double").alias("latitude"), parts[1].cast("double").alias("longitude"), WEIGHT))

    def fit(self, df: DataFrame) -> FittedPlace:
        require(df, [self.latitude, self.longitude], NUMERIC)
        return self._joined(distinct_places(df, self.latitude, self.longitude))

    def _joined(self, needed: DataFrame) -> FittedPlace:
        entries = self.places.select("latitude", "longitude", *place_columns(), F.lit(True).alias("known"))
        on = ["latitude", "longitude"]
        if self.tolerance_m is not None:
            found = nearest_places(needed, entries, self.tolerance_m, on)
            where = [F.col("place.latitude").alias("__lat"), F.col("place.longitude").alias("__lon")]
            entries = entries.withColumnsRenamed({"latitude": "__lat", "longitude": "__lon"})
            entries = found.select(*on, *where).join(entries, ["__lat", "__lon"]).drop("__lat", "__lon")
        table = freeze(needed.join(entries, on, "left"), on, given=True)
        given = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        verdict = table.frame.agg(
            F.count_if(given & ~X.valid_place("latitude", "longitude")).alias("invalid"),
            F.count_if(F.col("known").isNull()).alias("missing"),
        ).first()
        if verdict["invalid"]:
            raise ValueError(f"{verdict['invalid']} places are outside the valid latitude and longitude ranges")
        if verdict["missing"] and self.on_missing == "error":
            raise ValueError(f"{verdict['missing']} places have no entry in the table of places")
        return FittedPlace(self.latitude, self.longitude, self.on_missing, table)
