"""Nearest neighbours against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import cross_polytope
from coppice.llm.cross_polytope import SearchParams


def brute(ids, vectors, queries, k):
    score = vectors @ vectors.T
    out = {}
    for q in queries:
        order = sorted((-score[q, i], ids[i]) for i in range(len(ids)) if ids[i] != ids[q])
        out[ids[q]] = [(i, -s) for s, i in order[:k]]
    return out


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    ids, vectors = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    got = cross_polytope.nearest(spark.createDataFrame(e), F.col("vec_id") % 20 == 0).collect()
    want = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    assert len(got) == 20 * len(want)
    hits = 0
    for q, best in want.items():
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hits += len({r["vec_id"] for r in rows} & {i for i, _ in best})
        for r in rows:
            assert r["score"] == pytest.approx(vectors[ids == q][0] @ vectors[ids == r["vec_id"]][0], abs=1e-12)
    assert hits >= 0.9 * len(got)


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", 4)
    r = np.random.default_rng(1)
    vectors = np.round(np.concatenate([np.tile([1.0, 0, 0], (150, 1)), r.normal(size=(150, 3))]), 1)
    ids = np.arange(300)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, rank int")
    got = cross_polytope.nearest(df.repartition(3), F.col("vec_id") % 5 == 0, SearchParams(k=7, tables=2, probes=6))
    found = {}
    for x in got.orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    for q, best in brute(ids, vectors, range(0, 300, 5), 7).items():  # all axes are probed, so nothing is missed
        assert [i for i, _ in found.get(q, [])] == ([i for i, _ in best] if vectors[q].any() else [])


def test_odd_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]),
            (7, [1e200, 1e200]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in cross_polytope.nearest(df, F.lit(True)).collect()]
    assert sorted(got) == [(0, 1, 7), (0, 2, 1), (1, 1, 7), (1, 2, 0), (7, 1, 0), (7, 2, 1)]
    assert cross_polytope.nearest(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("copies", [2, 30])
@pytest.mark.parametrize("k,probes", [(7, 8), (38, 1)])  # all axes are probed, or all queries are compared with all rows
def test_copies_of_an_id_take_one_place(spark, copies, k, probes):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(40, 3))
    copied = np.repeat(vectors, copies, axis=0) * np.tile(np.linspace(1, 0.5, copies), 40)[:, None]
    ids = np.repeat(np.arange(40), copies)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, copied)], "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(df.repartition(3), F.col("vec_id") % 5 == 0, SearchParams(k=k, tables=1, probes=probes))
    found = {}
    for x in got.orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    score = copied @ copied.T
    for q in range(0, 40, 5):
        best = sorted((-score[np.ix_(ids == q, ids == i)].max(), i) for i in range(40) if i != q)[:k]
        assert [i for i, _ in found[q]] == [i for _, i in best]
        assert [s for _, s in found[q]] == pytest.approx([-s for s, _ in best], abs=1e-12)


@pytest.mark.parametrize("spread", [0.25, 0.5, 1.0])
def test_recall_of_unequal_norms(spark, spread):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    long = np.exp(spread * np.random.default_rng(1).standard_normal(len(e)))
    ids, vectors = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float) * long[:, None]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0).collect()
    want = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    hits = sum((q, i) in found for q, best in want.items() for i, _ in best)
    assert len(got) == 20 * len(want) and hits >= 0.93 * len(got)


def test_places_follow_the_length():
    places = cross_polytope.places_of
    assert places(np.array([0.1, 0.99, 1.0, 1.5, 2.0, 3.0, 9.0, np.inf]), 1.0, 16).tolist() == [1, 1, 1, 2, 4, 9, 16, 16]
    assert places(np.array([1.0, 5.0]), 0.0, 16).tolist() == places(np.array([1.0, 5.0]), np.inf, 16).tolist() == [1, 1]
