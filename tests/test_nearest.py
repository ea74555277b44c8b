import math

import pytest
from pyspark.sql import functions as F

from coppice.operators import nearest, place

PLACES = [
    ("b", 10.0, 20.0), ("a", 10.0, 20.0),  # a tie, which the smaller key wins
    ("north", 90.0, 0.0), ("south", -89.99, 77.0), ("east", 0.5, 179.99), ("west", 0.5, -179.0),
    ("lost", None, 5.0), ("nan", float("nan"), 5.0), ("off", 91.0, 5.0),
    *((f"p{i:03}", -60 + (i * 37 % 120) + i / 1000, -180 + (i * 91 % 360) + i / 700) for i in range(150)),
]
POINTS = [
    (10.0, 20.0), (10.0, 20.0), (10.1, 20.1), (89.9, -170.0), (-89.9, -103.0), (0.5, -179.98), (0.4, 180.0),
    (None, 1.0), (1.0, None), (float("nan"), 1.0), (95.0, 1.0), (0.0, -0.0),
    *((-80 + (i * 53 % 160) + i / 900, -180 + (i * 17 % 360) + i / 800) for i in range(120)),
]


def metres(a, b):
    """By the angle between the two, in another form than the operator's."""
    (p, q), (r, s) = (map(math.radians, x) for x in (a, b))
    half = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * nearest.EARTH_M * math.asin(min(1.0, math.sqrt(half)))


def usable(lat, lon):
    return lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180


def brute_force(point, tolerance):
    if not usable(*point):
        return None
    near = [(math.floor(metres(point, (lat, lon)) * 1000 + 0.5), k) for k, lat, lon in PLACES if usable(lat, lon)]
    best = min(near)
    return (best[1], best[0] / 1000) if best[0] <= tolerance * 1000 else None


def tables(spark):
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(POINTS)], "id int, lat double, lon double")
    return points, spark.createDataFrame(PLACES, "name string, latitude double, longitude double")


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("tolerance", [1.0, 250_000.0, 3_000_000.0, 30_000_000.0])
def test_nearest_is_brute_force(spark, monkeypatch, small, tolerance):
    if not small:
        monkeypatch.setattr(nearest, "SMALL_ROWS", 1)
    points, places = tables(spark)
    out = nearest.attach_nearest(points, "lat", "lon", places, tolerance, "name", "place", "metres").collect()
    assert len(out) == len(POINTS)
    for row in out:
        want = brute_force(POINTS[row["id"]], tolerance)
        if want is None:
            assert row["place"] is None and row["metres"] is None
        else:
            assert row["place"] == want[0] and abs(row["metres"] - want[1]) <= 0.002


def test_frequent_cubes_are_split(spark, monkeypatch):
    monkeypatch.setattr(nearest, "HOT_SHARE", 8)
    points = spark.range(400).select((F.col("id") / 1e5).alias("latitude"), F.lit(1.0).alias("longitude"))
    sphere = nearest._on_sphere(points, "__p")
    spots = nearest._on_sphere(points.limit(3).withColumn("place", F.lit("x")), "__s").drop("latitude", "longitude")
    left, right = nearest._split_hot(sphere, nearest._around(spots, 50_000.0), 50_000.0)
    sizes = {r["__part"]: r["count"] for r in left.groupBy("__part").count().collect()}
    assert len(sizes) > 3 and max(sizes.values()) <= 100
    assert right.select("__part").distinct().count() == len(sizes)


def test_empty_tables_and_bad_tolerance(spark):
    points, places = tables(spark)
    none = nearest.attach_nearest(points, "lat", "lon", places.limit(0), 1e6, "name", "place", "metres")
    assert none.count() == len(POINTS) and none.where("place is not null").isEmpty()
    assert nearest.attach_nearest(points.limit(0), "lat", "lon", places, 1e6, "name", "place", "metres").isEmpty()
    with pytest.raises(ValueError):
        nearest.attach_nearest(points, "lat", "lon", places, 0.0, "name", "place", "metres")


def test_features_of_the_nearest_place(spark):
    values = [F.lit(float(i)).alias(c) for i, c in enumerate(place.place_columns())]
    places = spark.createDataFrame([(10.0, 20.0), (50.0, 60.0)], "latitude double, longitude double").select("*", *values)
    df = spark.createDataFrame([(1, 10.001, 20.001), (2, 30.0, 30.0)], "id int, lat double, lon double")
    step = place.PlaceFeatures("lat", "lon", places, on_missing="null", tolerance_m=1000.0)
    out = {r["id"]: r[place.place_columns()[3]] for r in step.fit(df).transform(df).collect()}
    assert out == {1: 3.0, 2: None}
    exact = place.PlaceFeatures("lat", "lon", places, on_missing="null").fit(df).transform(df)
    assert exact.where(F.col(place.place_columns()[3]).isNotNull()).isEmpty()
    with pytest.raises(ValueError, match="no entry"):
        place.PlaceFeatures("lat", "lon", places, tolerance_m=1000.0).fit(df)
