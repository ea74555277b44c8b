import pytest
from pyspark.sql import functions as F

from coppice.operators import lookup


def skewed(spark, n=6000):
    """A third of the rows share key 0, a sixth have no key, the rest are spread."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 6 == 1, None).otherwise(F.col("id") % 50)
    return spark.range(n).select("id", key.cast("bigint").alias("k"))


def expected_counts(n=6000):
    keys = [0 if i % 3 == 0 else None if i % 6 == 1 else i % 50 for i in range(n)]
    return {i: None if k is None else keys.count(k) for i, k in list(enumerate(keys))[:200]}


def check_counts(df):
    rows = {r["id"]: r["n"] for r in df.filter("id < 200").collect()}
    assert rows == expected_counts()
    assert df.count() == 6000


def test_group_counts_small(spark):
    check_counts(lookup.join_group_counts(skewed(spark), "k", "n"))


def test_group_counts_large_and_skewed(spark, tiny_tables, no_broadcast):
    df = lookup.join_group_counts(skewed(spark), "k", "n")
    check_counts(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    # The frequent key and the missing keys do not end up in one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffled = df.filter("k = 0 or k is null").select(F.spark_partition_id().alias("p")).groupBy("p").count()
    sizes = [r["count"] for r in shuffled.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_null_safe_keys(spark, tiny_tables, no_broadcast):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    names = spark.createDataFrame([("a", "first"), (None, "none"), ("b", "second")], "k string, name string")
    out = lookup.dictionary_lookup(df, "k", names, "name")
    assert {r["id"]: r["name"] for r in out.collect()} == {1: "first", 2: "none", 3: None}


def test_dictionary_from_mapping_may_replace_its_column(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    out = lookup.dictionary_lookup(df, "k", {"a": "x"}, "k")
    assert {r["k"] for r in out.collect()} == {None, "x"}


def test_wide_keys_are_not_broadcast(spark):
    df = spark.createDataFrame([("x" * 5000,), ("y",)], "k string")
    table = lookup.freeze(lookup.count_keys(df, {"k": "k"}), ["k"])
    assert not table.small
    assert lookup.join_group_counts(df, "k", "n").agg(F.sum("n")).first()[0] == 2


def test_enrich_by_key(spark):
    out = lookup.enrich_by_key(skewed(spark), "k", lambda d: d.withColumn("twice", F.col("k") * 2))
    assert out.filter("k is not null and twice <> k * 2").isEmpty()
    assert out.filter("k is null and twice is not null").isEmpty()
    assert out.count() == 6000


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"))
    out, n = lookup.number_rows(df, ["v"], "i")
    assert n == 5000
    assert out.filter("i <> v").isEmpty()


def test_positional_join(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    right = spark.createDataFrame([(3, 30.0), (1, 10.0), (2, 20.0)], "o int, value double")
    out = lookup.positional_join(left, right, ["x"], ["o"], "value")
    assert sorted(out.collect()) == [("a", 10.0), ("b", 20.0), ("c", 30.0)]
    with pytest.raises(ValueError):
        lookup.positional_join(left, right.limit(2), ["x"], ["o"], "value")


def test_filter_by_dict_selects_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), (None, 2)], "g string, n int")
    assert lookup.filter_by_dict(df, {"g": None, "n": 1}).count() == 1
    assert lookup.filter_by_dict(df, {"g": "a"}).count() == 1
    assert lookup.filter_by_dict(df, {}).count() == 3


def test_sample_is_repeatable_and_near_the_cap(spark):
    df = spark.range(20000)
    once = lookup.sample_to_cap(df, 2000, ["id"])
    again = lookup.sample_to_cap(df.repartition(5), 2000, ["id"])
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    assert 1800 < once.count() < 2200
    assert lookup.sample_to_cap(df, 20000, ["id"]).count() == 20000


@pytest.mark.parametrize("large", [False, True])
def test_other_columns_may_have_dots(spark, large, request):
    if large:
        request.getfixturevalue("tiny_tables")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "`x.y` int, k string")
    out = lookup.join_group_counts(df, "k", "n")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 2), (2, "a", 2), (3, "b", 1)]


def test_frequent_keys_of_a_large_dictionary(spark, tiny_tables, no_broadcast):
    """Key 0 has an entry, key 7 and null have none, key 9 has a wide one."""
    key = F.when(F.col("id") % 4 == 0, 0).when(F.col("id") % 4 == 1, 7).when(F.col("id") % 4 == 2, 9)
    df = spark.range(4000).select("id", key.cast("bigint").alias("k"))
    wide = "w" * 5000
    entries = spark.createDataFrame([(0, "zero"), (9, wide), (100, "rare")], "k bigint, name string")
    out = lookup.dictionary_lookup(df, "k", entries, "name")
    counts = {(r["k"], r["name"]): r["count"] for r in out.groupBy("k", "name").count().collect()}
    assert counts == {(0, "zero"): 1000, (7, None): 1000, (9, wide): 1000, (None, None): 1000}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    apart = out.filter("k = 7 or k is null").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(apart) == 8


def test_repeated_keys_of_a_given_table(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "key int, value string")
    with pytest.raises(ValueError, match="repeated"):
        lookup.dictionary_lookup(df, "k", twice, "v")


def test_array_values_are_not_broadcast(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    entries = spark.createDataFrame([(1, [1, 2]), (2, [3])], "key int, value array<int>")
    assert lookup.take_small(entries) is None
    got = {r["k"]: r["v"] for r in lookup.dictionary_lookup(df, "k", entries, "v").collect()}
    assert got == {1: [1, 2], 2: [3], 3: None}


@pytest.mark.parametrize("bits", [16, 3])
@pytest.mark.parametrize("cap", [0, 1, 137, 999, 1000, 1001])
def test_exact_sample(spark, monkeypatch, bits, cap):
    monkeypatch.setattr(lookup, "DRAW_BITS", bits)
    df = spark.range(1000).repartition(7).withColumn("draw", F.lit("x"))
    got = sorted(r["id"] for r in lookup.sample_exactly(df, cap, ["id"]).collect())
    hashes = df.select("id", lookup.unit_hash("sample/7", "id").alias("h")).orderBy("h").limit(cap).collect()
    assert got == sorted(r["id"] for r in hashes) and len(got) == min(cap, 1000)


def test_exact_sample_of_repeated_keys(spark):
    df = spark.range(900).selectExpr("id % 3 AS k", "id")
    assert [lookup.sample_exactly(df, cap, ["k"]).count() for cap in (1, 300, 450, 900, 0)] == [1, 300, 450, 900, 0]
    once = {r["id"] for r in lookup.sample_exactly(df, 450, ["k"]).collect()}
    assert once == {r["id"] for r in lookup.sample_exactly(df.repartition(5), 450, ["k"]).collect()}
    assert lookup.sample_exactly(df.filter("false"), 5, ["k"]).isEmpty()
