import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.functions import schema as S
from coppice.operators import dates, encode, place, scale, steps, weight
from coppice.queries import REGISTERED as QUERIES

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture
def letters(spark):
    rows = [(i, ALPHABET[i % 26], float(i), float(i + 1)) for i in range(100)]
    return spark.createDataFrame(rows, "id int, p string, q double, qbase double").repartition(4)


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- basic steps and chains


def test_row_sum(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (3, 6), (None, 1)], "a long, b long")
    out = steps.RowSum(("a", "b")).transform(df)
    assert [r["sum_a+b"] for r in out.collect()] == [5, 7, 9, None]
    with pytest.raises(TypeError):
        steps.RowSum(("a", "b")).inverse(out)


def test_constant_and_keep(spark):
    df = spark.range(2)
    out = steps.Constant(1.5).transform(df)
    assert out.columns == ["id", "constant_1_5"]
    assert steps.Constant(1.5).inverse(out) is out
    assert steps.Keep(("id",)).transform(df).columns == ["id"]
    with pytest.raises(ValueError):
        steps.Keep(("nope",)).transform(df)


def test_chain_fits_on_transformed_data(letters):
    """The second step reads a column the first one makes."""
    log = scale.Log("q")
    chain = steps.Chain((log, scale.ZScore("log1p_q", "p")))
    assert chain.input_columns == ["q", "p"]
    fitted = chain.fit(letters)
    out = fitted.transform(letters)
    assert out.groupBy("p").agg(F.abs(F.avg(fitted.output_columns[-1])).alias("m")).filter("m > 1e-9").isEmpty()
    back = fitted.inverse(out.drop("q", "log1p_q"))
    assert same_rows(back.select("id", F.round("q", 6).alias("q")), letters.select("id", "q"))


def test_fit_does_not_change_the_step(letters):
    step = encode.Ordinal("p")
    assert step.fit(letters.filter("p < 'd'")).num_classes == 3
    assert step.fit(letters).num_classes == 26


# --- encoders


def test_ordinal_codes_are_sorted(letters):
    fitted = encode.Ordinal("p").fit(letters)
    out = fitted.transform(letters)
    assert {r["p"]: r["ordinal_p"] for r in out.collect()} == {c: i for i, c in enumerate(ALPHABET)}
    assert same_rows(fitted.inverse(out.drop("p")).select("id", "p"), letters.select("id", "p"))


def test_ordinal_large(letters, tiny_tables, no_broadcast):
    fitted = encode.Ordinal("p").fit(letters)
    assert not fitted.table.small
    out = fitted.transform(letters)
    assert {r["p"]: r["ordinal_p"] for r in out.collect()} == {c: i for i, c in enumerate(ALPHABET)}
    assert same_rows(fitted.inverse(out.drop("p")).select("id", "p"), letters.select("id", "p"))


@pytest.mark.parametrize("large", [False, True])
def test_ordinal_null_unseen_and_extend(spark, large, request):
    if large:
        request.getfixturevalue("tiny_tables")
    first = spark.createDataFrame([("b",), (None,), ("d",)], "p string")
    second = spark.createDataFrame([("c",), ("a",), ("d",), (None,)], "p string")
    fitted = encode.Ordinal("p").fit(first)
    assert {r["p"]: r["ordinal_p"] for r in fitted.transform(second).collect()} == {"c": None, "a": None, "d": 2, None: 0}
    more = fitted.extend(second)
    assert more.num_classes == 5
    assert {r["p"]: r["ordinal_p"] for r in more.transform(second).collect()} == {None: 0, "d": 2, "a": 3, "c": 4}
    assert more.extend(first) is more
    assert fitted.num_classes == 3


def test_ordinal_rejects_numbers_and_empty(letters):
    with pytest.raises(TypeError):
        encode.Ordinal("q").fit(letters)
    with pytest.raises(ValueError):
        encode.Ordinal("p").fit(letters.limit(0))
    with pytest.raises(TypeError):
        encode.distinct_levels(letters, "q")


def test_one_hot_names_values_and_decode(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(100)], "id int, p string")
    fitted = encode.OneHot("p").fit(df)
    out = fitted.transform(df)
    assert fitted.output_columns == ["onehot_p_is_a", "onehot_p_is_b", "onehot_p_is_c"]
    assert out.filter("onehot_p_is_a + onehot_p_is_b + onehot_p_is_c <> 1").isEmpty()
    assert out.filter("(onehot_p_is_b = 1) <> (p = 'b')").isEmpty()
    assert same_rows(fitted.inverse(out.drop("p")).select("id", "p"), df)


def test_one_hot_null_unseen_and_clashing_names(spark):
    df = spark.createDataFrame([("a b",), ("a_b",), (None,)], "p string")
    fitted = encode.OneHot("p").fit(df)
    assert fitted.output_columns == ["onehot_p_is_a_b", "onehot_p_is_a_b_2"]
    out = fitted.transform(df.union(spark.createDataFrame([("new",)], "p string")))
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0), (0, 1), (0, 0), (0, 0)]
    with pytest.raises(Exception, match="exactly one indicator"):
        fitted.inverse(out.drop("p")).collect()
    lenient = encode.OneHot("p", on_invalid="null").fit(df)
    assert [r["p"] for r in lenient.inverse(out.drop("p")).collect()] == ["a b", "a_b", None, None]


def test_one_hot_decode_rejects_negative(spark):
    fitted = encode.FittedOneHot("p", ("a", "b", "c"), on_invalid="null")
    df = spark.createDataFrame([(1, 1, -1), (0, 1, 0)], ", ".join(f"{c} int" for c in fitted.output_columns))
    assert [r["p"] for r in fitted.inverse(df).collect()] == [None, "b"]


def test_one_hot_limit(letters):
    with pytest.raises(ValueError, match="more than 1 levels"):
        encode.OneHot("p", max_levels=1).fit(letters)


def test_one_hot_of_many_levels(spark):
    df = spark.range(1500).selectExpr("id", "concat('level ', id % 600) as p")
    fitted = encode.OneHot("p").fit(df)
    assert len(fitted.output_columns) == 600
    assert same_rows(fitted.inverse(fitted.transform(df).drop("p")).select("id", "p"), df)


@pytest.mark.parametrize("large", [False, True])
def test_one_hot_vector(spark, large, request):
    if large:
        request.getfixturevalue("tiny_tables")
    df = spark.createDataFrame([("a b",), ("a_b",), (None,), ("c",)], "p string")
    fitted = encode.OneHotVector("p").fit(df)
    out = fitted.transform(df.union(spark.createDataFrame([("new",)], "p string")))
    got = {r["p"]: r["onehot_p"].toArray().tolist() for r in out.collect()}
    assert got == {"a b": [1, 0, 0], "a_b": [0, 1, 0], "c": [0, 0, 1], None: [0, 0, 0], "new": [0, 0, 0]}
    with pytest.raises(Exception, match="exactly one indicator"):
        fitted.inverse(out.drop("p")).collect()
    lenient = encode.OneHotVector("p", on_invalid="null").fit(df)
    back = lenient.inverse(out, into="again")
    assert {r["p"]: r["again"] for r in back.collect()} == {"a b": "a b", "a_b": "a_b", "c": "c", None: None, "new": None}
    dense = [([0.0, 1.0, 0.0], "a_b"), ([1.0, 1.0, -1.0], None), ([0.0, 0.0, 2.0], None)]
    rows = spark.createDataFrame([(Vectors.dense(v), want) for v, want in dense], ["onehot_p", "want"])
    assert [r["p"] for r in lenient.inverse(rows).orderBy("want").collect()] == [None, None, "a_b"]


def test_one_hot_vector_of_more_levels_than_columns_can_be(spark):
    df = spark.range(30_000).selectExpr("id", "concat('level ', id) as p")
    fitted = encode.OneHotVector("p").fit(df)
    assert same_rows(fitted.inverse(fitted.transform(df).drop("p")).select("id", "p"), df)


def test_one_hot_decode_wide_has_no_limit_on_levels(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    assert same_rows(QUERIES["one_hot_decode_wide"].run(spark, str(tmp_path)), rows)


def test_row_sum_of_many_columns(spark):
    names = [f"c{i}" for i in range(700)]
    df = spark.range(3).select(*((F.col("id") + i).alias(c) for i, c in enumerate(names)))
    got = [r[0] for r in df.select(X.add_up(names)).collect()]
    assert got == [sum(range(700)) + 700 * i for i in range(3)]


# --- scalers


@pytest.mark.parametrize("group", [None, "p"])
def test_zscore_roundtrip(letters, group):
    fitted = scale.ZScore("q", group).fit(letters)
    out = fitted.transform(letters)
    back = fitted.inverse(out.drop("q")).select("id", F.round("q", 6).alias("q"))
    assert same_rows(back, letters.select("id", "q"))


@pytest.mark.parametrize("large", [False, True])
def test_zscore_uses_its_group(spark, large, request):
    if large:
        request.getfixturevalue("tiny_tables")
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 10.0), ("c", 5.0), ("c", 5.0), (None, 2.0), (None, 4.0)], "g string, x double"
    )
    fitted = scale.ZScore("x", "g").fit(df)
    root = math.sqrt(0.5)
    got = sorted((str(r["g"]), round(r["zscore_x_by_g"], 9)) for r in fitted.transform(df).collect())
    want = [("None", -root), ("None", root), ("a", -root), ("a", root), ("b", 0.0), ("c", 0.0), ("c", 0.0)]
    assert got == [(g, round(z, 9)) for g, z in want]
    unseen = spark.createDataFrame([("z", 7.0), ("a", None)], "g string, x double")
    assert [r["zscore_x_by_g"] for r in fitted.transform(unseen).collect()] == [7.0, None]


def test_zscore_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["zscore_x"] for r in scale.ZScore("x").fit(df).transform(df).collect()] == [0.0, 0.0]


def test_mean_std(letters):
    row = scale.mean_std(letters, "q").first()
    assert row["group"] == "all" and row["mean"] == 49.5 and row["stddev"] == pytest.approx(29.011491975882016)
    single = scale.mean_std(letters.filter("id = 3"), "q", "p").first()
    assert (single["group"], single["mean"], single["stddev"]) == ("d", 3.0, 1.0)


def test_ratio_roundtrip_null_and_zero(spark, letters):
    step = scale.Ratio("q", "qbase")
    out = step.transform(letters)
    back = step.inverse(out.drop("q")).select("id", F.round("q", 9).alias("q"))
    assert same_rows(back, letters.select("id", "q"))
    df = spark.createDataFrame([(6.0, 3.0), (6.0, None), (6.0, 0.0)], "q double, qbase double")
    assert [r["ratio_q_by_qbase"] for r in step.transform(df).collect()] == [2.0, 6.0, None]


def test_log(spark, letters):
    fitted = scale.Log("q").fit(letters)
    out = fitted.transform(letters)
    assert out.filter("abs(log1p_q - ln(1 + q)) > 1e-12").isEmpty()
    with pytest.raises(ValueError, match="1 negative"):
        scale.Log("q").fit(spark.createDataFrame([(-1.0,), (2.0,)], "q double"))
    # Checked at fit only: a later negative value is no error.
    assert fitted.transform(spark.createDataFrame([(-0.5,)], "q double")).first()["log1p_q"] < 0


# --- dates and weights


def test_conform_date(spark):
    text = spark.createDataFrame([("2021-03-01",), ("no date",), (None,)], "d string")
    out = dates.conform_date(text, "d")
    assert dict(out.dtypes)["d"] == "timestamp"
    assert [str(r["d"]) for r in out.collect()] == ["2021-03-01 00:00:00", "None", "None"]
    for kind in ("date", "timestamp_ntz"):
        cast = spark.createDataFrame([("2021-03-01",)], "d string").select(F.col("d").cast(kind))
        assert str(dates.conform_date(cast, "d").first()["d"]) == "2021-03-01 00:00:00"


def test_season_terms(spark):
    df = spark.range(100).select(F.date_add(F.lit("2021-01-01"), F.col("id").cast("int")).cast("timestamp").alias("dt"))
    season = dates.Season("dt")
    assert len(season.output_columns) == 58 == len(set(season.output_columns))
    rows = season.transform(df).orderBy("dt").collect()
    for i in (0, 17, 99):
        row = rows[i]
        dt = row["dt"]
        values = {
            "day_of_week": (dt.weekday(), 6),
            "day_of_month": (dt.day, 31),
            "week_of_year": (dt.isocalendar()[1], 52.1429),
            "day_of_year": (dt.timetuple().tm_yday - 1, 365.25),
        }
        for name in season.output_columns:
            part, kind, phase = name.removeprefix("season_").rsplit("_", 2)
            value, period = values[part]
            want = getattr(math, kind)(2 * math.pi * (value + int(phase)) / period)
            assert row[name] == pytest.approx(want, abs=1e-12)
    columns = {tuple(round(r[c], 9) for r in rows) for c in season.output_columns}
    # Half a period apart two terms differ by their sign only; no two are equal.
    assert len(columns) == 58


def test_sine_at_known_points(spark):
    from coppice.functions.columns import wave

    row = spark.range(1).selectExpr(f"{wave('0D', 1, 0, 'sin')} AS a", f"{wave('0.25D', 1, 0, 'sin')} AS b").first()
    assert row["a"] == pytest.approx(0) and row["b"] == pytest.approx(1)


def test_decay(spark):
    weekly = spark.range(100).select(
        F.date_sub(F.lit("2000-01-01"), (F.col("id") * 7).cast("int")).cast("timestamp").alias("dt")
    )
    out = weight.Decay("dt", 100.0).fit(weekly).transform(weekly)
    newest, lowest, highest = out.agg(F.max_by("decay_dt", "dt"), F.min("decay_dt"), F.max("decay_dt")).first()
    assert newest == highest == 1.0 and lowest == pytest.approx(0)
    df = spark.createDataFrame([("2021-01-01 06:00:00",), ("2020-01-07 05:00:00",), ("2020-12-31 07:00:00",), (None,)], "t string")
    df = dates.conform_date(df, "t")
    got = [r["decay_t"] for r in weight.Decay("t", 1.0).fit(df).transform(df).collect()]
    assert got[0] == 1.0
    assert got[1] == pytest.approx(math.exp(-360 / 360.25))
    assert got[2] == 1.0  # 23 hours are no whole day
    assert got[3] is None


def test_decay_errors(spark):
    with pytest.raises(ValueError):
        weight.Decay("dt", -1.0)
    old = dates.conform_date(spark.createDataFrame([("2020-01-01",)], "d string"), "d")
    new = dates.conform_date(spark.createDataFrame([("2020-01-02",)], "d string"), "d")
    with pytest.raises(Exception, match="newer than the fitted"):
        weight.Decay("d", 1.0).fit(old).transform(new).collect()


@pytest.mark.parametrize("large", [False, True])
def test_balance(spark, large, request):
    if large:
        request.getfixturevalue("tiny_tables")
    df = spark.createDataFrame([(c,) for c in "AAAABBC"] + [(None,)], "c string")
    out = weight.Balance("c").fit(df).transform(df)
    assert sorted(((r["c"] or "", r["balance_c"]) for r in out.distinct().collect()), key=str) == [
        ("", None), ("A", 0.25), ("B", 0.5), ("C", 1.0),
    ]
    with pytest.raises(TypeError):
        weight.Balance("n").fit(spark.range(3).withColumnRenamed("id", "n"))


def test_balance_by_day(spark):
    df = spark.createDataFrame([("2021-01-01 01:00:00",), ("2021-01-01 23:00:00",), ("2021-01-02 00:00:00",)], "t string")
    df = dates.conform_date(df, "t")
    out = weight.Balance("t").fit(df).transform(df).orderBy("t")
    assert [r["balance_t"] for r in out.collect()] == [0.5, 0.5, 1.0]


# --- places


def places(spark):
    values = ", ".join(f"{i}D AS {c}" for i, c in enumerate(place.place_columns()))
    return spark.sql(f"SELECT 43.65107D AS latitude, -79.347015D AS longitude, {values}")


def test_place_features(spark):
    assert len(place.place_columns()) == 12
    df = spark.createDataFrame([(43.65107, -79.347015), (43.65107, -79.347015)], "lat double, lon double")
    step = place.PlaceFeatures("lat", "lon", places(spark))
    assert step.input_columns == ["lat", "lon"]
    rows = step.fit(df).transform(df).collect()
    assert [r["place_area_600"] for r in rows] == [1.0, 1.0]
    assert step.fit(df).transform(df).columns == ["lat", "lon", *place.place_columns()]


def test_place_misses(spark):
    known = spark.createDataFrame([(43.65107, -79.347015)], "lat double, lon double")
    other = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    with pytest.raises(ValueError, match="no entry"):
        place.PlaceFeatures("lat", "lon", places(spark)).fit(other)
    strict = place.PlaceFeatures("lat", "lon", places(spark)).fit(known)
    with pytest.raises(Exception, match="no entry"):
        strict.transform(other).collect()
    lenient = place.PlaceFeatures("lat", "lon", places(spark), on_missing="null")
    assert lenient.fit(known.union(other)).transform(other).first()["place_area_60"] is None
    with pytest.raises(ValueError, match="outside"):
        lenient.fit(spark.createDataFrame([(91.0, 0.0)], "lat double, lon double"))


def test_place_provider(spark):
    columns = place.place_columns()

    def ask(batch):
        return batch.assign(**{c: batch["latitude"] + i for i, c in enumerate(columns)})

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    table = place.places_from_provider(place.distinct_places(df, "lat", "lon"), ask)
    out = place.PlaceFeatures("lat", "lon", table).fit(df).transform(df)
    assert sorted(r["place_area_600"] for r in out.collect()) == [2.0, 2.0, 4.0]


# --- schema helpers


def test_schema_checks(letters):
    assert S.columns_of(letters, S.NUMERIC) == ["id", "q", "qbase"]
    ok, messages = S.inspect(letters, ["p", "nope", "q"], S.CATEGORICAL)
    assert not ok and len(messages) == 2
    assert S.combine([(True, []), (False, ["x"])]) == (False, ["x"])
    with pytest.raises(TypeError):
        S.require(letters, ["q"], S.TEMPORAL)
    assert S.tag_name("ä b-1") == "ä_b_1"
    assert S.distinct_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
