"""The nearest of many places, by a join on grid cells.

Points of the globe are taken as points of the unit sphere in space, cut into
cubes. What lies within the side of a cube is in the same cube or in one of the
26 around it, at the poles and at the date line as anywhere else.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.operators.lookup import HOT_SHARE, SMALL_ROWS, local_frame
from coppice.session import materialise

# Fixed value: mean radius of the earth in metres.
EARTH_M = 6_371_008.8
#: A search starts at this share of the tolerance and widens by the factor, so that dense areas meet small cubes only.
FIRST_SHARE, WIDEN = 1 / 64, 8
_CELL = ("__c0", "__c1", "__c2")


def distance_mm(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Great-circle distance of two points of the unit sphere in whole millimetres."""
    square = sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))
    arc = F.asin(F.least(F.sqrt(square) / 2, F.lit(1.0)))
    return F.floor(arc * F.lit(2000 * EARTH_M) + 0.5)


def nearest_places(points: DataFrame, places: DataFrame, tolerance_m: float, key: Sequence[str]) -> DataFrame:
    """The nearest place of each distinct point within ``tolerance_m`` metres, along the globe.

    Both tables have ``latitude`` and ``longitude`` in degrees. Returns
    ``latitude``, ``longitude`` and ``distance_mm`` of the points that have one,
    and the ``key`` columns of the place under ``place``. Distances are compared
    in whole millimetres; ties go to the smallest key. Coordinates that are
    null, NaN or out of range, of points and of places, match nothing.

    Up to ``SMALL_ROWS`` places are broadcast with the cubes around them. More
    are joined by shuffle, in cubes of growing size: a point is done when a
    place stands within the side of a cube, because then no nearer one can be
    elsewhere. Cubes with more than one in ``HOT_SHARE`` points are split.
    """
    if not tolerance_m > 0:
        raise ValueError("the tolerance must be above 0")
    todo = _on_sphere(points.select(*_degrees()).where(X.valid_place("latitude", "longitude")).distinct(), "__p")
    spots = places.select(*_degrees(), F.struct(*(X.col(c).alias(c) for c in key)).alias("place"))
    spots = _on_sphere(spots.where(X.valid_place("latitude", "longitude")), "__s").drop("latitude", "longitude")
    spots = materialise(spots)
    if spots.count() <= SMALL_ROWS:
        return _within(todo, F.broadcast(_around(spots, tolerance_m)), tolerance_m)
    todo, found, reach = materialise(todo), [], tolerance_m * FIRST_SHARE
    while True:
        left, right = _split_hot(todo, _around(spots, reach), reach)
        found.append(materialise(_within(left, right, reach)))
        if reach >= tolerance_m:
            break
        done = found[-1].select("latitude", "longitude")
        todo = materialise(todo.join(done, ["latitude", "longitude"], "left_anti"))
        if todo.isEmpty():
            break
        reach = min(reach * WIDEN, tolerance_m)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _degrees() -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]


def _on_sphere(df: DataFrame, prefix: str) -> DataFrame:
    lat, lon = F.radians("latitude"), F.radians("longitude")
    place = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return df.withColumns({f"{prefix}{i}": value for i, value in enumerate(place)})


def _cell(prefix: str, i: int, reach: float) -> Column:
    """The cube along an axis; its side is a little more than the chord of ``reach``."""
    side = 2 * math.sin(min((reach + 0.001) / EARTH_M, math.pi) / 2) * (1 + 1e-9)
    return F.floor(F.col(f"{prefix}{i}") / F.lit(side))


def _around(spots: DataFrame, reach: float) -> DataFrame:
    """Each place once for each of the 27 cubes from which it may be reached."""
    for i, c in enumerate(_CELL):
        cell = _cell("__s", i, reach)
        spots = spots.select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias(c))
    return spots


def _split_hot(points: DataFrame, around: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Deal the points of a frequent cube to parts, and its places to each of them.

    Fewer than ``HOT_SHARE`` cubes can be frequent, so their table is small.
    """
    points = points.withColumns({c: _cell("__p", i, reach) for i, c in enumerate(_CELL)})
    counted = points.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))
    total = points.count()
    parts = F.least(F.ceil(F.col("n") * F.lit(HOT_SHARE) / F.lit(max(total, 1))), F.col("n")).cast("int")
    rows = counted.where(F.col("n") * HOT_SHARE > total).select(*_CELL, parts.alias("__parts")).collect()
    hot = F.broadcast(local_frame(
        points.sparkSession, [r.asDict() for r in rows], ", ".join(f"{c} bigint" for c in _CELL) + ", __parts int"))
    parts = F.coalesce("__parts", F.lit(1))
    left = points.join(hot, list(_CELL), "left").withColumn(
        "__part", F.pmod(F.xxhash64("latitude", "longitude"), parts).cast("int"))
    right = around.join(hot, list(_CELL), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("__parts"), right.drop("__parts")


def _within(points: DataFrame, around: DataFrame, reach: float) -> DataFrame:
    """The nearest place of each point that has one within ``reach``."""
    if "__part" in around.columns:
        keys = [*_CELL, "__part"]
    else:
        keys, points = list(_CELL), points.withColumns({c: _cell("__p", i, reach) for i, c in enumerate(_CELL)})
    far = distance_mm([F.col(f"__p{i}") for i in range(3)], [F.col(f"__s{i}") for i in range(3)])
    met = points.join(around, keys).select("latitude", "longitude", far.alias("mm"), "place")
    best = met.where(F.col("mm") <= F.lit(math.floor(reach * 1000))).groupBy("latitude", "longitude").agg(
        F.min(F.struct("mm", "place")).alias("best"))
    return best.select("latitude", "longitude", F.col("best.mm").alias("distance_mm"), F.col("best.place").alias("place"))


def attach_nearest(df: DataFrame, latitude: str, longitude: str, places: DataFrame, tolerance_m: float,
                   key: str, output: str, distance: str) -> DataFrame:
    """Add the ``key`` of the nearest place and its ``distance`` in metres; null where none is within the tolerance.

    Rows and other columns are unchanged, repeated rows included. Points are
    made distinct first, so a frequent point is searched once.
    """
    names = ["__lat", "__lon"]
    at = df.withColumns({n: X.col(c).cast("double") for n, c in zip(names, (latitude, longitude))})
    found = nearest_places(at.select(F.col("__lat").alias("latitude"), F.col("__lon").alias("longitude")), places, tolerance_m, [key])
    found = found.select(F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"),
                         F.col("place").getField(key).alias(output), (F.col("distance_mm") / 1000).alias(distance))
    return at.join(found, names, "left").drop(*names)
