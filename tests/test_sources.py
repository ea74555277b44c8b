import pytest
from pyspark.sql import functions as F

from coppice.sources import files, synth


def test_load_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "n int, s string, x double")
    files.write_csv(df, str(tmp_path / "t.csv"))
    files.write_parquet(df, str(tmp_path / "t.parquet"))
    for name in ("t.csv", "t.parquet"):
        got = files.load(spark, str(tmp_path / name))
        assert got.dtypes == df.dtypes
        assert sorted(got.collect()) == sorted(df.collect())
    assert files.load(spark, str(tmp_path / "t.csv"), "n bigint, s string, x double").dtypes[0] == ("n", "bigint")
    with pytest.raises(ValueError):
        files.load(spark, "table.txt")
    cached, n = files.ingest(spark, str(tmp_path / "t.parquet"), ["n"])
    assert n == 2 and cached.columns == ["n"] and cached.is_cached
    cached.unpersist()
    assert files.preview(df, [F.col("n").desc()], 1).first()["n"] == 2


def test_rows_from_lists_and_arrays(spark):
    assert files.rows_from_lists(spark, {"a": [1, 2], "b": ["x", "y"]}).collect() == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        files.rows_from_lists(spark, {"a": [1, 2], "b": ["x"]})
    df = spark.createDataFrame([(1, [1, 2], ["x", "y"])], "id int, a array<int>, b array<string>")
    assert files.rows_from_arrays(df, ["a", "b"]).collect() == [(1, 1, "x"), (1, 2, "y")]
    bad = spark.createDataFrame([(1, [1, 2], ["x"])], "id int, a array<int>, b array<string>")
    with pytest.raises(Exception, match="differ in length"):
        files.rows_from_arrays(bad, ["a", "b"]).collect()


def test_generators(spark):
    assert synth.generate_iid(spark, 100).count() == 100
    ts = synth.generate_ts(spark, 100)
    assert ts.count() == 100 and str(ts.agg(F.min("date"), F.max("date")).first()[1]) == "2000-04-09 00:00:00"
    multi = synth.generate_multi_ts(spark, ["A", "B"], num_days=100)
    assert multi.count() == 200 and multi.select("ts_type", "date").distinct().count() == 200
    place = synth.generate_spatial(spark, 100)
    assert place.count() == 100 and place.select("location_name", "lat", "lon").distinct().count() == 3
    assert synth.generate_iid(spark, n_categorical=0, n_numeric=10).columns == [f"numeric_{i}" for i in range(10)]


def test_generated_values(spark):
    df = synth.generate_iid(spark, 20000, seed=3)
    mean, std, letters = df.agg(F.avg("numeric_0"), F.stddev("numeric_0"), F.count_distinct("categorical_0")).first()
    assert abs(mean) < 0.03 and abs(std - 1) < 0.03 and letters == 26
    assert abs(df.stat.corr("numeric_0", "numeric_1")) < 0.03
    assert df.agg(F.count_if(F.col("numeric_0") == F.col("numeric_1"))).first()[0] == 0
    again = synth.generate_iid(spark, 20000, seed=3).repartition(3)
    assert df.exceptAll(again).isEmpty()
    assert not df.exceptAll(synth.generate_iid(spark, 20000, seed=4)).isEmpty()


def test_csv_keeps_text(spark, tmp_path):
    rows = [(1, 'a "b" c'), (2, "line\nbreak, comma"), (3, ""), (4, None), (5, '"'), (6, "\\"), (7, " x ")]
    df = spark.createDataFrame(rows, "id int, text string")
    path = str(tmp_path / "t.csv")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == sorted(rows, key=lambda r: r[0])
    assert files.load(spark, path, df.schema, multiLine=True).count() == len(rows)
