"""Forests from counted rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from coppice import Roles, TrainParams, predict, train
from coppice.plans import forest
from coppice.plans.boosting import Places, SoftmaxTrees, Tree
from coppice.plans.forest import ForestModel, ForestTrees
from coppice.plans.registry import Registry


def vectors(spark, x, y, w, copies):
    rows = [(a.tolist(), float(b), float(c), int(n)) for a, b, c, n in zip(x, y, w, copies)]
    rows = spark.createDataFrame(rows, "x array<double>, label double, weight double, copies long")
    return rows.repartition(3).select(array_to_vector("x").alias("features"), "label", "weight", "copies")


def plain_tree(codes, y, w, nominal, depth):
    """Shares of the classes in every row's leaf, every split tried on raw rows."""
    def impurity(rows):
        sums = np.array([w[rows & (y == k)].sum() for k in range(3)])
        return sums.sum() - (sums**2).sum() / sums.sum(), sums / sums.sum()

    out, nodes = np.zeros((len(y), 3)), [np.ones(len(y), bool)]
    for level in range(depth + 1):
        after = []
        for rows in nodes:
            best, (at_node, shares) = (1e-9, None), impurity(rows)
            for f in range(codes.shape[1]):
                present = np.unique(codes[rows, f])
                orders = [present]
                if f in nominal:
                    share = [[w[rows & (codes[:, f] == b) & (y == k)].sum() / w[rows & (codes[:, f] == b)].sum() for b in present] for k in range(3)]
                    orders = [present[np.lexsort((present, s))] for s in share]
                for order in orders:
                    for i in range(len(order) - 1):
                        left = rows & np.isin(codes[:, f], order[: i + 1])
                        gain = at_node - impurity(left)[0] - impurity(rows & ~left)[0]
                        if gain > best[0] * (1 + 1e-9):
                            best = gain, (left, rows & ~left)
            if best[1] is None or level == depth:
                out[rows] = shares
            else:
                after += best[1]
        nodes = after
    return out


@pytest.fixture
def sample():
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=300), r.integers(0, 5, 300), r.normal(size=300).round(1)])
    y = np.where(x[:, 1] == 2, 2, np.where(x[:, 0] + x[:, 2] > 0.3, 1, 0))
    return x, y, r.uniform(0.5, 2, 300), r.integers(1, 4, 300)


@pytest.mark.parametrize("sums", [1 << 23, 1])
def test_one_tree_as_plain_version(spark, sample, monkeypatch, sums):
    monkeypatch.setattr(forest, "SUMS_PER_PASS", sums)  # all nodes in one pass, or each in one of its own
    x, y, w, copies = sample
    model = ForestTrees(3, {1: 6}, trees=1, depth=3, bins=16).fit(vectors(spark, x, y, w, copies))
    assert model.scores(x) == pytest.approx(plain_tree(model.bins.of(x), y, w, {1}, 3), abs=1e-9)
    assert sum(model.featureImportances) == pytest.approx(1)
    assert np.isfinite(model.scores(np.array([[0.0, 5.0, 0.0], [0.0, 99.0, np.inf]]))).all()


def test_counted_rows_are_drawn_as_single_ones(spark):
    """The root's share of a class varies as the mean of 3,000 rows does, not of three."""
    x, y = np.zeros((3, 1)), np.array([0, 1, 2])
    model = ForestTrees(3, {}, trees=400, depth=1).fit(vectors(spark, x, y, np.full(3, 1000.0), [1000] * 3))
    shares = np.array([tree.value[0][0] for (tree,) in model.trees])
    assert abs(shares.mean() - 1 / 3) < 0.002
    assert shares.std() == pytest.approx(np.sqrt(1 / 3 * 2 / 3 / 3000), rel=0.2)


def test_trees_read_cells_and_not_rows(spark, sample, monkeypatch):
    """Fifty rows of nearly the same values for each: as many cells, the same trees."""
    x, y, w, copies = sample
    near = np.repeat(x, 50, axis=0)
    read = []
    plain = forest.Bins.cells

    def counting(self, *given):
        cells = plain(self, *given)
        read.append(cells.count())
        return cells

    monkeypatch.setattr(forest.Bins, "cells", counting)
    near[:, 2] += np.tile(np.arange(50) * 1e-6, 300)
    rows = vectors(spark, near, np.repeat(y, 50), np.ones(15_000), np.ones(15_000))
    ForestTrees(3, {1: 6}, trees=3, depth=2, bins=8).fit(rows)
    SoftmaxTrees(3, {1: 6}, rounds=1, depth=2, bins=8).fit(rows)
    assert max(read) <= 8 * 5 * 8 * 3 and len(read) == 2


def test_forest_learns_and_is_saved(spark, tmp_path):
    df = spark.range(600).selectExpr("cast(id % 17 as double) as v", "concat('k', id % 3) as c", "concat('t', (id % 17) % 4) as kind")
    trained = train(Roles(target="kind", target_is_categorical=True, features=("v", "c")), df, TrainParams(trees=20, depth=8, partitions=2))
    store = Registry(spark, str(tmp_path / "store"))
    again = store.read_model(store.write_model(trained))
    assert isinstance(again.model, ForestModel)
    both = predict(again, predict(trained, df, "a"), "b")
    assert both.filter("a <> b").isEmpty() and both.filter("a = kind").count() > 500
    other = train(trained.roles, df.repartition(5), TrainParams(trees=20, depth=8, partitions=2))
    assert [vars(t) for (t,) in other.model.trees] == [vars(t) for (t,) in trained.model.trees]


@pytest.mark.parametrize("depth", [0, 3, 8])
def test_places(depth):
    r, tree = np.random.default_rng(depth), Tree()
    for _ in range(depth):
        for node in [n for n, f in enumerate(tree.feature) if f < 0]:
            f = int(r.integers(3))
            levels = sorted(r.choice(9, 4, replace=False).tolist()) if f == 1 else None
            tree.split(node, f, int(r.integers(9)), levels, (0.0, 0.0))
    bins = r.integers(0, 9, (3, 500))
    found = Places(tree, (9, 9, 9))
    assert (len(found.leaves) > 64) == (depth == 8)
    at = []
    for row in bins.T:
        node = 0
        while tree.feature[node] >= 0:
            value = row[tree.feature[node]]
            goes_left = value <= tree.limit[node] if tree.levels[node] is None else value in tree.levels[node]
            node = tree.left[node] + (not goes_left)
        at.append(node)
    assert found.order()[found.of(bins)].tolist() == at
