"""Synthetic tables, drawn column by column from the rows' ids.

Every value depends on (seed, column, id) only, so any part of a table can be
recomputed anywhere with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.columns import normal_hash, unit_hash

# Category letters, place names with latitude and longitude, first day of a series.
LETTERS = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PLACES = {
    "Toronto": (43.653908, -79.384293),
    "Tokyo": (35.652832, 139.839478),
    "Sydney": (-33.870453, 151.208755),
}
FIRST_DAY = "2000-01-01"


def iid(ids: DataFrame, key: Sequence[str], n_categorical: int = 2, n_numeric: int = 2, seed: int = 0) -> DataFrame:
    """Add ``categorical_i`` (a letter, uniform) and ``numeric_i`` (standard normal) to the rows."""
    letters = F.array(*(F.lit(c) for c in LETTERS))
    columns = {}
    for i in range(n_categorical):
        draw = unit_hash(f"{seed}/categorical_{i}", *key)
        columns[f"categorical_{i}"] = F.get(letters, F.floor(draw * len(LETTERS)).cast("int"))
    for i in range(n_numeric):
        columns[f"numeric_{i}"] = normal_hash(f"{seed}/numeric_{i}", *key)
    return ids.withColumns(columns) if columns else ids


def generate_iid(spark: SparkSession, n: int = 1000, **shape) -> DataFrame:
    return iid(spark.range(n), ["id"], **shape).drop("id")


def series(days: DataFrame, day_number: str, date_column: str = "date", **shape) -> DataFrame:
    """One row per day number (from 0), dated from the first day on."""
    date = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.col(day_number).cast("int")).cast("timestamp")
    return iid(days, [day_number], **shape).withColumn(date_column, date)


def generate_ts(spark: SparkSession, num_days: int = 750, date_column: str = "date", **shape) -> DataFrame:
    return series(spark.range(num_days), "id", date_column, **shape).drop("id")


def multi_series(
    types: DataFrame, type_column: str, num_days: int = 750, date_column: str = "date", **shape
) -> DataFrame:
    """One series of ``num_days`` for each row of ``types``."""
    days = types.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(num_days - 1))))
    date = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.col("day")).cast("timestamp")
    return iid(days, [type_column, "day"], **shape).withColumn(date_column, date).drop("day")


def generate_multi_ts(
    spark: SparkSession, ts_types: Sequence[str], ts_type_column: str = "ts_type", num_days: int = 750, **shape
) -> DataFrame:
    types = spark.createDataFrame([(t,) for t in ts_types], f"{ts_type_column} string")
    return multi_series(types, ts_type_column, num_days, **shape)


def spatial(
    ids: DataFrame,
    key: Sequence[str],
    latitude: str = "lat",
    longitude: str = "lon",
    name: str = "location_name",
    seed: int = 0,
    **shape,
) -> DataFrame:
    """Add one of the named places, uniform, with its coordinates."""
    places = F.array(
        *(
            F.struct(F.lit(n).alias("name"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
            for n, (lat, lon) in PLACES.items()
        )
    )
    drawn = F.get(places, F.floor(unit_hash(f"{seed}/place", *key) * len(PLACES)).cast("int"))
    return (
        iid(ids, key, seed=seed, **shape)
        .withColumn("__place", drawn)
        .withColumns(
            {name: F.col("__place.name"), latitude: F.col("__place.lat"), longitude: F.col("__place.lon")}
        )
        .drop("__place")
    )


def generate_spatial(spark: SparkSession, num_locations: int = 100, **shape) -> DataFrame:
    return spatial(spark.range(num_locations), ["id"], **shape).drop("id")


def write_fixtures(spark: SparkSession, folder: str) -> dict[str, str]:
    """The seven sample tables of the test-suite; returns name -> path."""
    tables = {
        "sample_iid.csv": generate_iid(spark, seed=1),
        "sample_ts.csv": generate_ts(spark, seed=2),
        "sample_ts.parquet": generate_ts(spark, seed=3),
        "sample_multi_ts.csv": generate_multi_ts(spark, ["ts_A", "ts_B"], seed=4),
        "sample_spatial.csv": generate_spatial(spark, seed=5),
        "sample_numeric_iid.csv": generate_iid(spark, n_categorical=0, n_numeric=10, seed=6),
        "sample_categorical_iid.csv": generate_iid(spark, n_categorical=10, n_numeric=0, seed=7),
    }
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        if name.endswith(".csv"):
            df.write.option("header", True).csv(paths[name])
        else:
            df.write.parquet(paths[name])
    return paths
