"""Whitening against numpy on whole matrices."""

import numpy as np
import pytest

from coppice.llm import whitening


def expected(ids, vectors, k):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(got, ids, vectors, k):
    deviation, projected, shares = expected(ids, vectors, k)
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    found = np.array([[rows[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((found * projected).sum(axis=0))
    assert np.abs(found * signs - projected).max() < 1e-9
    assert [int(rows[i][1]["deviation"]) for i in ids] == deviation
    assert [rows[ids[0]][c + 1]["explained"] for c in range(k)] == pytest.approx(shares, rel=1e-9)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    e = df.toPandas()
    compare(whitening.whiten(df.repartition(3)).collect(), e["vec_id"].tolist(), e["embedding"].tolist(), 8)


def test_many_blocks_and_wide_sums(spark, monkeypatch):
    """Blocks of five rows; entries so large that deviations need more than 63 bits."""
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 20)
    vectors = np.random.default_rng(3).normal(size=(333, 4)) * [1e6, 2e6, 3e6, 4e6]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string").repartition(7)
    got = whitening.whiten(df).collect()
    assert max(r["deviation"] for r in got) > 2**63
    compare(got, list(range(333)), vectors, 4)


def test_odd_rows(spark):
    odd = [(3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1e300, 1.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), *odd], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["whitened"] is None) for r in got) == [
        (0, 1, False), (0, 2, True), (1, 1, False), (1, 1, False), (1, 2, True), (1, 2, True)]
    assert {r["n"] for r in got} == {3} and all(r["identity_error"] < 1e-9 for r in got)
    flat = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in flat] == [(None, None, None, 0)] * 4
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []
    assert whitening.whiten(df.where("false")).columns == whitening.whiten(df).columns


def test_blocks_grow_with_the_table():
    assert whitening.block_rows(1000, 64) == 4096
    assert whitening.block_rows(10**10, 64) == 38147
    assert whitening.block_rows(10**12, 64) == 131072
    assert whitening.block_rows(10, 10**8) == 1
