"""Hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import hard_negatives
from coppice.llm.hard_negatives import MiningParams, Scores, spanning_tree


def brute(rows, anchor, params=MiningParams()):
    rows = sorted({(i, lab, tuple(int(np.floor(params.scale * c)) for c in v)) for i, lab, v in rows})
    out = []
    for a, lab, x in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, m) for i, m, y in rows if i != a and len(x) == len(y))
        for s, i, m in [r for r in scored if r[2] == lab][: params.positives]:
            inside = [(j, -t) for t, j, m2 in scored if m2 != lab and -params.low * s <= -100 * t <= -params.high * s]
            out += [(a, i, k + 1, j, -s, t) for k, (j, t) in enumerate(inside[: params.negatives])]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 5 == 0, **options).collect()))


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_small_trees_and_blocks(spark, monkeypatch, dense):
    """Many trees and blocks, clustered rows, a label of half the rows; with and without whole products."""
    monkeypatch.setattr(hard_negatives, "TREE_ANCHORS", 6)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "DENSE", dense)
    r = np.random.default_rng(4)
    vectors = r.normal(size=(8, 5))[r.integers(8, size=300)] + r.normal(size=(300, 5)) * 0.2
    labels = np.where(r.random(300) < 0.5, 0, r.integers(1, 4, 300))
    rows = [(i, int(m), v.tolist()) for i, (m, v) in enumerate(zip(labels, vectors))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("tree", F.lit("x"))
    assert mined(df.repartition(4)) == brute(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.6, 0.0]), (3, 2, [0.6, 0.0]), (3, 2, [0.6, 0.0]),
            (4, 2, [0.5, 0.5]), (5, 3, [0.0, 0.0]), (6, 3, [0.0, 1.0]), (0, 2, [0.7, 0.0]), (10, 7, [1.0, 1.0]), (11, 1, [1.0, 2.0, 3.0])]
    out = [(20, None, [1.0, 0.0]), (25, 1, None), (30, 1, [nan, 1.0]), (35, 1, [None, 1.0]), (40, 1, []), (45, 1, [1e300, 0.0]),
           (None, 1, [0.95, 0.0]), (50, 1, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows + out, "vec_id long, label int, embedding array<double>")
    got = mined(df)
    assert got == brute(rows, lambda i: i % 5 == 0)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 10")) == []


def test_scores_beyond_doubles(spark):
    rows = [(0, 1, [200_000.0, 3.0, 1.0]), (1, 1, [200_000.0, 3.0, 2.0]), (2, 2, [120_000.0, 3.0, 1.0]), (3, 2, [120_000.0, 3.0, 2.0])]
    wide = [(i, m, v + [199_999.0] * 5) for i, m, v in rows]
    df = spark.createDataFrame(wide, "vec_id long, label int, embedding array<double>")
    got = mined(df)
    assert got == brute(wide, lambda i: i % 5 == 0) and got[0][4] > 2**53


def test_other_label_and_parameters(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, r.normal(size=3).tolist()) for i in range(60)]
    params = MiningParams(positives=2, negatives=1, low=10, high=80, scale=100)
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    moved = [(i, (m + 1) % 3 if i % 7 == 0 else m, v) for i, m, v in rows]
    assert mined(df, params=params, label=label) == brute(moved, lambda i: i % 5 == 0, params)


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(6).normal(size=(40, 3))
    order, parents, edges = spanning_tree(points)
    assert sorted(order) == list(range(40)) and parents[0] == -1 and all(p < i for i, p in enumerate(parents) if i)
    assert edges[1:] == pytest.approx([np.linalg.norm(points[order[i]] - points[order[p]]) for i, p in enumerate(parents) if i])
    distance = np.linalg.norm(points[:, None] - points[None], axis=2)
    group, total = list(range(40)), 0.0
    for i, j in sorted(((i, j) for i in range(40) for j in range(i)), key=lambda x: distance[x]):  # Kruskal's rule
        if group[i] != group[j]:
            total += distance[i, j]
            group = [group[i] if g == group[j] else g for g in group]
    assert edges.sum() == pytest.approx(total)


def test_bounds_hold_and_save_scoring():
    """Close anchors: scores are exact where needed, inside the bounds elsewhere, and few pairs are scored."""
    r = np.random.default_rng(7)
    anchors = np.round(1000 + r.normal(size=(50, 8)) * 3).astype(np.int64)
    candidates = np.round(r.normal(size=(400, 8)) * 200).astype(np.int64)
    order, parents, edges = spanning_tree(anchors.astype(float))
    anchors = anchors[order]
    truth = anchors @ candidates.T
    scores = Scores(anchors, candidates)
    least = np.sort(truth, axis=1)[:, -10, None]
    for members, low, high in scores.walk(parents, edges, lambda m, lo, hi: hi >= least[m]):
        assert (low <= truth[members]).all() and (truth[members] <= high).all()
        needed = truth[members] >= least[members]
        assert (low[needed] == truth[members][needed]).all() and (high[needed] == truth[members][needed]).all()
    assert scores.scored < 0.5 * truth.size
