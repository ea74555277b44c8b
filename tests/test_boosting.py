"""Softmax trees against a plain version that looks at all rows at once."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from coppice import Roles, TrainParams, predict, train
from coppice.plans import boosting
from coppice.plans.boosting import SoftmaxModel, SoftmaxTrees
from coppice.plans.registry import Registry


def plain_scores(x, y, w, classes, nominal, bins, rounds, depth, step):
    """Every split tried for every node, on raw sums."""
    scores = np.zeros((len(x), classes))
    codes = bins.of(x)
    for _ in range(rounds):
        chance = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        grown = np.zeros_like(scores)
        for k in range(classes):
            g = w * (chance[:, k] - (y == k))
            h = w * chance[:, k] * (1 - chance[:, k]) * classes / (classes - 1)
            leaves = [(np.ones(len(x), bool), 0.0)]
            for _ in range(depth):
                after = []
                for rows, value in leaves:
                    best = (1e-9, None)
                    for f in range(x.shape[1]):
                        present = np.unique(codes[rows, f])
                        if f in nominal:
                            mean = [g[rows & (codes[:, f] == b)].sum() / h[rows & (codes[:, f] == b)].sum() for b in present]
                            present = present[np.lexsort((present, mean))]
                        for i in range(len(present) - 1):
                            left = rows & np.isin(codes[:, f], present[: i + 1])
                            right = rows & ~left
                            gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                            if gain > best[0] * (1 + 1e-9):
                                best = gain, (left, right)
                    if best[1] is None:
                        grown[rows, k] = value
                        continue
                    after += [(s, -step * g[s].sum() / h[s].sum()) for s in best[1]]
                leaves = after
            for rows, value in leaves:
                grown[rows, k] = value
        scores += grown
    return scores


def test_as_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=400), r.integers(0, 5, 400), r.normal(size=400).round(1)])
    y = np.where(x[:, 1] == 2, 2, np.where(x[:, 0] + x[:, 2] > 0.3, 1, 0))
    w = r.uniform(0.5, 2, 400)
    rows = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, label double, weight double")
    rows = rows.repartition(3).select(array_to_vector("x").alias("features"), "label", "weight")
    model = SoftmaxTrees(3, {1: 6}, rounds=5, depth=3, step=0.3, bins=16).fit(rows)
    assert model.scores(x) == pytest.approx(plain_scores(x, y, w, 3, {1}, model.bins, 5, 3, 0.3), abs=1e-9)
    assert sum(model.featureImportances) == pytest.approx(1)
    assert max(len(t.feature) for grown in model.trees for t in grown) <= 15
    again = model.transform(rows).filter(F.col("prediction") != F.col("label")).count()
    assert again <= 24  # of 400: a slanted border, five rounds, sixteen bins
    unseen = model.scores(np.array([[0.0, 5.0, 0.0], [0.0, 99.0, np.inf]]))
    assert np.isfinite(unseen).all()


def test_saved_and_loaded(spark, tmp_path):
    df = spark.range(300).selectExpr("cast(id % 17 as double) as v", "concat('k', id % 3) as c", "concat('t', (id % 17) % 4) as kind")
    roles = Roles(target="kind", target_is_categorical=True, features=("v", "c"))
    trained = train(roles, df, TrainParams(trees=3, depth=4, multiclass="softmax", partitions=2))
    store = Registry(spark, str(tmp_path / "store"))
    again = store.read_model(store.write_model(trained))
    assert isinstance(again.model, SoftmaxModel)
    both = predict(again, predict(trained, df, "a"), "b")
    assert both.filter("a <> b").isEmpty() and both.filter("a = kind").count() > 200
