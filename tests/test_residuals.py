"""The boosted trees of a number: cells, keys of dates, exact quantiles, one task or many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.operators.dates import Season
from coppice.plans import residuals
from coppice.plans.model import TrainParams, predict, train
from coppice.plans.registry import Registry
from coppice.plans.residuals import ResidualModel, packed, quantiles
from coppice.plans.roles import Roles


@pytest.fixture(scope="module")
def prices(spark):
    df = spark.range(3000).select(
        "id", (F.pmod(F.hash("id"), F.lit(1000)) / 10.0).alias("v"), F.concat(F.lit("s"), F.pmod(F.hash("id", F.lit(1)), F.lit(4))).alias("c"),
        F.when(F.col("id") % 50 != 0, F.timestamp_micros(F.lit(8 * 10**14) + F.pmod(F.hash("id", F.lit(2)), F.lit(900)) * 86_400_000_000)).alias("day"))
    price = 100 + F.col("v") * F.when(F.col("c") == "s1", 3).otherwise(1) + 40 * F.coalesce(F.dayofyear("day"), F.lit(0)) / 366
    return df.withColumn("y", price).cache()


ROLES = Roles(target="y", date="day", groups=("c",), features=("v", "c"))


def test_few_cells_take_few_jobs(spark, prices):
    """Jobs for each level of each tree made training take hours on large tables."""
    spark.sparkContext.setJobGroup("few cells", "")
    trained = train(ROLES, prices, TrainParams(trees=60, depth=3))
    spark.sparkContext.setJobGroup("others", "")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few cells")
    assert 0 < len(jobs) < 120
    assert len(trained.model.trees) == 60 and trained.dropped_rows == 60  # no day, no weight
    scored = predict(trained, prices, "p")
    error, spread = scored.agg(F.avg((F.col("p") - F.col("y")) ** 2), F.var_pop("y")).first()
    assert error < 0.05 * spread


@pytest.mark.parametrize("on_driver", [0, 1 << 30])
def test_many_tasks_grow_the_same_trees_as_one(prices, monkeypatch, on_driver, tmp_path, spark):
    params = TrainParams(trees=7, depth=4, partitions=3)
    near = train(ROLES, prices, params)
    for name, value in {"NEAR": 0, "SUMS_ON_DRIVER": on_driver, "STORE_EVERY": 2, "BLOCK": 2000, "VALUES_PER_BLOCK": 300, "SUMS_PER_PASS": 1}.items():
        monkeypatch.setattr(residuals, name, value)
    far = train(ROLES, prices.repartition(5), params)
    both = predict(far, predict(near, prices, "a"), "b")
    assert both.filter("abs(a - b) > 1e-9 * abs(a)").isEmpty()
    assert far.model.featureImportances.toArray() == pytest.approx(near.model.featureImportances.toArray(), abs=1e-9)
    store = Registry(spark, str(tmp_path / "models"))
    again = store.read_model(store.write_model(far))
    assert isinstance(again.model, ResidualModel)
    assert predict(again, predict(far, prices, "a"), "b").filter("a <> b").isEmpty()


def test_first_tree_has_weighted_means_and_others_a_fifth_of_what_is_left(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 3.0), ("b", -10.0), ("b", -10.0), ("c", 50.0)]
    df = spark.createDataFrame(rows, "c string, y double")
    trained = train(Roles(target="y", features=("c",)), df, TrainParams(trees=1, depth=1))
    means = {r["c"]: r["p"] for r in predict(trained, df, "p").collect()}
    assert means["c"] == pytest.approx(50.0) and means["a"] == means["b"] == pytest.approx(-13 / 5)
    trained = train(Roles(target="y", features=("c",)), df, TrainParams(trees=2, depth=1, step=0.25))
    moved = {r["c"]: r["p"] for r in predict(trained, df, "p").collect()}
    left = {"a": 7 / 3 + 13 / 5, "b": -10 + 13 / 5, "c": 0.0}  # best split: b against the others
    others = (3 * left["a"] + left["c"]) / 4
    assert moved == pytest.approx({"a": -13 / 5 + 0.5 * others, "b": -13 / 5 + 0.5 * left["b"], "c": 50 + 0.5 * others})


def test_deep_trees_have_more_leaves_than_bits_in_a_word(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("u"), F.floor(F.col("id") / 20).cast("double").alias("v"),
                                 F.pmod(F.hash("id"), F.lit(997)).cast("double").alias("y"))
    trained = train(Roles(target="y", features=("u", "v")), df, TrainParams(trees=1, depth=14))
    assert len(trained.model.trees[0].leaves()) > 128
    model, tree = trained.model, trained.model.trees[0]
    u, v = (np.arange(400) % 20).astype(float), (np.arange(400) // 20).astype(float)
    codes = model.layout.codes(lambda i: (u, v)[i], lambda: None)
    bins = [np.searchsorted(model.layout.bounds[i], x) for i, x in enumerate((u, v))]
    walked = []
    for row in range(400):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] + (not tree.goes_left(node, bins[tree.feature[node]][row]))
        walked.append(tree.value[node])
    assert model.scores(codes).tolist() == walked and len(set(walked)) > 128


def test_a_rare_value_has_a_bin(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 4, 0.0).otherwise(1.0).alias("v"), F.when(F.col("id") < 4, 9.0).otherwise(2.0).alias("y"))
    assert predict(train(Roles(target="y", features=("v",)), df, TrainParams(trees=1, depth=1)), df, "p").filter("abs(p - y) > 1e-9").isEmpty()


def test_quantiles_are_exact(spark):
    values = np.concatenate([np.random.default_rng(3).normal(size=500) * 10.0 ** np.arange(-10, 10).repeat(25), [0.0, -0.0, 5e-324, -1e308, 1e308] * 3])
    df = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(values)], "a double, b double").repartition(5)
    ranks = [1, 2, 100, 250, 257, 400, len(values)]
    assert quantiles(packed(df, ["a", "b"]), ["a", "b"], ranks) == [[float(np.sort(values)[r - 1]) for r in ranks], [float(np.sort(np.arange(len(values)) % 3)[r - 1]) for r in ranks]]


def test_the_calendar_has_the_terms_of_all_dates(spark):
    season = Season("day")
    keys, terms = season.calendar(spark)
    assert keys == sorted(set(keys)) and len(keys) < 20_000
    days = spark.range(3000).select(F.expr("timestamp_seconds((id * 7919 * 86400) % 200000000000 - 60000000000 + id % 86400)").alias("day"))
    known = dict(zip(keys, terms))
    rows = season.transform(days.withColumn("key", season.key())).collect()
    assert {r["key"] for r in rows} <= set(keys)
    for r in rows:
        assert all(math.isclose(r[c], t, rel_tol=0, abs_tol=0) for c, t in zip(season.output_columns, known[r["key"]]))
    assert spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS day").select(season.key()).first()[0] is None


def test_labels_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, float("nan"))], "v double, y double")
    with pytest.raises(ValueError, match="finite"):
        train(Roles(target="y", features=("v",)), df, TrainParams(trees=1, depth=1))
