import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coppice.functions.schema import distinct_names, tag_name
from coppice.operators import lookup, stats
from coppice.plans.roles import Roles, column_roles, target_choice


def pearson(xs, ys):
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    sxy = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
    sxx, syy = sum((x - mx) ** 2 for x in xs), sum((y - my) ** 2 for y in ys)
    return sxy / math.sqrt(sxx * syy) if sxx * syy > 0 else None


def indicators(values):
    if any(isinstance(v, str) for v in values):
        return [[1.0 if v == level else 0.0 for v in values] for level in sorted({v for v in values if v is not None})]
    return [[0.0 if v is None else float(v) for v in values]]


def brute_force(a, b):
    found = [pearson(x, y) for x, y in itertools.product(indicators(a), indicators(b))]
    return max((c for c in found if c is not None), key=lambda c: (round(abs(c), 12), c), default=None)


def random_table(seed, n=120):
    rng = random.Random(seed)
    few = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(n)]
    # Each level of `tied` goes with some levels of `few` only.
    tied = [rng.choice({"a": "xy", "b": "yz", "c": "w"}.get(f, "xyzw")) for f in few]
    many = [rng.choice("klmnopqrst") for _ in range(n)]
    number = [rng.choice([None, rng.gauss(0, 1) + (2 if f == "b" else 0)]) for f in few]
    whole = [rng.randrange(10) for _ in range(n)]
    return {"few": few, "tied": tied, "many": many, "number": number, "whole": whole}


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_collapsed_correlation_against_brute_force(spark, seed, large, request):
    if large:
        request.getfixturevalue("tiny_tables")
    data = random_table(seed)
    df = spark.createDataFrame(
        list(zip(*data.values())), "few string, tied string, many string, number double, whole int"
    )
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.collapsed_correlation(df, list(data)).collect()}
    assert len(got) == 25
    for a, b in itertools.combinations(data, 2):
        assert got[a, b] == got[b, a] == pytest.approx(brute_force(data[a], data[b]), abs=1e-9), (a, b)
    assert all(got[c, c] == 1.0 for c in data)


def test_category_that_decides_a_number(spark):
    df = spark.createDataFrame([("abc"[i % 3], [0, 0, 1][i % 3]) for i in range(100)], "cat string, num int")
    assert all(r["corr"] == pytest.approx(1.0, rel=1e-3) for r in stats.collapsed_correlation(df, ["cat", "num"]).collect())


def test_correlation_types_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (2.0, 2.0, False)], "x double, same double, flag boolean")
    with pytest.raises(TypeError):
        stats.collapsed_correlation(df, ["x", "flag"])
    rows = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.collapsed_correlation(df, ["x", "same"]).collect()}
    assert rows["x", "same"] is None


def test_matrix_and_collapsed_agree(spark):
    data = random_table(3)
    df = spark.createDataFrame(list(zip(data["few"], data["number"])), "few string, number double")
    matrix = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation_matrix(df, ["few", "number"]).collect()}
    levels = [matrix[f"onehot_few_is_{v}", "number"] for v in "abc"]
    best = max(levels, key=lambda c: (abs(c), c))
    assert best == pytest.approx(brute_force(data["few"], data["number"]), abs=1e-9)


def test_top_correlated_is_the_most_correlated(spark):
    rows = [(float(i), 2.0 * i, float((i * 7919) % 13), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "y double, strong double, weak double, cat string")
    top = stats.top_correlated(df, "y").first()
    assert top["column"] == "strong" and top["corr"] == pytest.approx(1.0)
    assert stats.top_correlated(df.select("y", "strong"), "y").isEmpty()
    choice = target_choice(Roles(target="y", features=("weak", "cat")), df).first()
    assert (choice["log"], choice["scale_by_number"], choice["scale_by_category"]) == (True, None, None)
    choice = target_choice(Roles(target="y", features=("weak", "strong")), df).first()
    assert choice["scale_by_number"] == "strong"
    choice = target_choice(Roles(target="cat", target_is_categorical=True, features=("weak",)), df).first()
    assert choice["is_categorical"] and not choice["log"]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_duplicates_by_digest(spark, monkeypatch, few):
    """Zeros of either sign, NaN, nulls, nested values and clashing names; rows whose digests agree but values do not."""
    monkeypatch.setattr(stats, "MANY_DIGESTS", few)
    nan = float("nan")
    rows = [(0.0, "a", [1]), (-0.0, "a", [1]), (nan, "b", [2]), (nan, "b", [2]), (None, None, None), (None, None, None), (1.0, "c", [1]), (1.0, "c", [2])]
    df = spark.createDataFrame(rows, "x double, __digest_a string, l array<int>")
    got = {(str(r["x"]), r["__digest_a"], r["copies"]) for r in stats.duplicate_rows(df).collect()}
    assert {(x.replace("-", ""), s, n) for x, s, n in got} == {("0.0", "a", 2), ("nan", "b", 2), ("None", None, 2)}
    assert stats.duplicate_rows(df, ["l"]).count() == 3
    monkeypatch.setattr(stats, "row_digest", lambda df, columns: [F.lit(1), F.lit(2)])  # all digests agree
    assert stats.duplicate_rows(df).count() == 3


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None)], "n int, s string")
    assert stats.has_duplicates(df)
    assert stats.has_duplicates(df, ["s"])
    assert not stats.has_duplicates(df.distinct())
    assert [tuple(r) for r in stats.duplicate_rows(df).collect()] == [(1, "a", 2)]


def test_profile_and_degenerate(spark):
    df = spark.createDataFrame([(1, "x", None, 5.0), (3, None, None, None)], "n int, s string, none double, once double")
    rows = {r["column"]: r for r in stats.profile(df).collect()}
    assert rows["n"]["mean"] == 2.0 and rows["n"]["stddev"] == pytest.approx(math.sqrt(2))
    assert rows["s"]["count"] == 1 and rows["s"]["min_text"] == "x" and rows["s"]["mean"] is None
    assert rows["once"]["stddev"] is None
    assert {r["column"] for r in stats.degenerate_columns(df).collect()} == {"s", "none", "once"}
    offered = {(r["column"], r["role"]) for r in column_roles(df, target="n").collect()}
    assert ("n", "target") in offered and ("n", "feature") not in offered
    assert ("s", "target") not in offered and ("s", "group") in offered and ("s", "date") in offered


def test_single_statistics(spark):
    df = spark.createDataFrame([(3, "a"), (-1, "b"), (None, "a")], "n int, s string")
    assert stats.min_value(df, "n").first()[0] == -1
    assert stats.row_count(df).first()[0] == 3
    assert [r["s"] for r in stats.distinct_groups(df, ["s"]).collect()] == ["a", "b"]
    assert [r["n"] for r in stats.fill_null_zero(df).collect()] == [3, -1, 0]


def test_correlation_takes_nan_as_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, float("nan")), (3.0, None), (4.0, 9.0)], "v double, b double")
    plain = df.fillna(0.0)
    for f in (stats.correlation_matrix, stats.collapsed_correlation):
        got = {tuple(r)[:2]: r["corr"] for r in f(df, ["v", "b"]).collect()}
        assert got["v", "b"] == pytest.approx(plain.corr("v", "b"))


def test_wide_correlation(spark, monkeypatch):
    names = [f"c{i}" for i in range(40)]
    df = spark.range(200).select(*((F.rand(i) + F.col("id") * (i % 3) / 100).alias(c) for i, c in enumerate(names))).cache()
    want = df.toPandas().corr()
    for width in (1000, 10):
        monkeypatch.setattr(stats, "MATRIX_WIDTH", width)
        for r in stats.collapsed_correlation(df, names).collect():
            assert r["corr"] == pytest.approx(want.loc[r["col_a"], r["col_b"]])


def test_matrix_of_many_levels(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(draw.choice([None, *"abc"]), f"v{draw.randint(0, 39)}" + draw.choice("!?"), draw.choice([1.0, 2.0, None]), 7) for _ in range(300)]
    df = spark.createDataFrame(rows, "few string, `a.many` string, number double, same int")
    plain = {"number": [r[2] or 0.0 for r in rows], "same": [r[3] for r in rows]}
    for k, c in enumerate(["few", "a.many"]):
        levels = sorted({r[k] for r in rows} - {None})
        names = distinct_names(f"onehot_{c}_is_{tag_name(v)}" for v in levels)
        plain |= {name: [float(r[k] == v) for r in rows] for name, v in zip(names, levels)}
    want = pd.DataFrame(plain).corr()
    for small in (4096, 8):
        monkeypatch.setattr(lookup, "SMALL_ROWS", small)
        monkeypatch.setattr(stats, "LEVEL_BLOCK", 512 if small > 8 else 16)
        found = stats.correlation_matrix(df, ["few", "a.many", "number", "same"]).collect()
        assert len(found) == len(plain) ** 2 == len({tuple(r)[:2] for r in found})
        for r in found:
            expected = 1.0 if r["col_a"] == r["col_b"] else want.loc[r["col_a"], r["col_b"]]
            assert r["corr"] == pytest.approx(expected, abs=1e-9, nan_ok=True)
    assert stats.correlation_matrix(df.limit(0), ["few", "number"]).isEmpty()
