import pytest

from coppice.plans import evaluate
from coppice.plans.roles import Roles


@pytest.fixture
def scored(spark):
    rows = [(1, 10.0, 12.0, "a", "a"), (2, 0.0, 1.0, "b", "a"), (3, 5.0, None, None, "a"), (4, 20.0, 20.0, "b", "b")]
    return spark.createDataFrame(rows, "id int, y double, prediction double, c string, guess string")


def test_errors(scored):
    numeric = evaluate.numeric_error(scored, "y", "prediction").orderBy("id")
    assert [r["error"] for r in numeric.collect()] == [0.2, None, None, 0.0]
    classes = evaluate.categorical_error(scored, "c", "guess").orderBy("id")
    assert [r["error"] for r in classes.collect()] == [0, 1, 1, 0]


def test_gate(scored):
    roles = Roles(target="y", features=("id",))
    evaluate.check_evaluation(scored, roles)
    with pytest.raises(ValueError, match="repeat"):
        evaluate.check_evaluation(scored.union(scored), roles)
    with pytest.raises(ValueError, match="target"):
        evaluate.check_evaluation(scored.drop("y"), roles)
    with pytest.raises(ValueError, match="not numeric"):
        evaluate.check_evaluation(scored, Roles(target="c", features=("id",)))


def test_long_form_and_histogram(scored):
    long = evaluate.actual_and_predicted(scored, "y", keep=["id"])
    assert long.count() == 8 and long.filter("is_prediction").count() == 4
    bins = {(r["bin"], r["n"]) for r in evaluate.histogram(scored, "y", 4).collect()}
    assert bins == {(0, 1), (1, 1), (2, 1), (3, 1)}
    constant = evaluate.histogram(scored.selectExpr("1.0D AS y"), "y", 4).collect()
    assert [tuple(r) for r in constant] == [(0, 4)]


def test_scatter_set(scored):
    roles = Roles(target="y", features=("id", "c"))
    assert evaluate.scatter_set(scored, roles, ["id"], "id", "c").columns == ["y", "id", "c"]
    assert evaluate.scatter_set(scored, roles, ["id"]).columns == ["y"]
    assert evaluate.scatter_set(scored, roles, ["id"], cap=2).count() < 4
    with pytest.raises(ValueError):
        evaluate.scatter_set(scored, roles, ["id"], "guess")


def test_spatial_and_series_sets(scored):
    roles = Roles(target="y", date="c", latitude="prediction", longitude="id", features=("id",))
    assert evaluate.spatial_set(scored, roles, "guess").columns == ["id", "c", "prediction", "y", "guess"]
    assert evaluate.series_set(scored, roles, "id").columns == ["c", "y", "id"]
    assert "error" in evaluate.spatial_evaluation(scored, roles).columns
    assert evaluate.group_slice(scored, None) is scored
    assert evaluate.group_slice(scored, {"c": None}).count() == 1


def test_histogram_keeps_odd_numbers_apart(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    got = {r["bin"]: r["n"] for r in evaluate.histogram(df, "v", 2).collect()}
    assert got == {0: 1, 1: 1, None: 2}
