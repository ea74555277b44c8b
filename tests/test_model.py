import pytest
from pyspark.sql import functions as F

from coppice import Roles, TrainParams, predict, train
from coppice.operators import place
from coppice.plans import contract
from coppice.plans.model import importance_buckets, importance_table, prediction_preview, try_predict
from coppice.plans.registry import Registry, new_key, quota
from coppice.plans.roles import ModelRoles, TargetRole, WeightRoles, feature_roles, weight_roles
from coppice.sources import files, synth

FEW = TrainParams(trees=2, depth=3)


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    return synth.write_fixtures(spark, str(tmp_path_factory.mktemp("samples")))


def iid(target, categorical, features, **roles):
    return Roles(target=target, target_is_categorical=categorical, features=features, **roles)


TWO = ["categorical_0", "categorical_1", "numeric_1"]
CASES = {
    "iid numeric": ("sample_iid.csv", iid("numeric_0", False, TWO)),
    "iid categorical": ("sample_iid.csv", iid("categorical_0", True, ["categorical_1", "numeric_0", "numeric_1"])),
    "ts numeric": ("sample_ts.csv", iid("numeric_0", False, TWO, date="date")),
    "ts numeric parquet": ("sample_ts.parquet", iid("numeric_0", False, TWO, date="date")),
    "ts categorical": ("sample_ts.csv", iid("categorical_0", True, ["categorical_1", "numeric_0"], date="date")),
    "multi ts numeric": ("sample_multi_ts.csv", iid("numeric_0", False, TWO, date="date", groups=["ts_type"])),
    "multi ts binary": ("sample_multi_ts.csv", iid("ts_type", True, [*TWO, "numeric_0"], date="date")),
    "spatial numeric": ("sample_spatial.csv", iid("numeric_0", False, TWO, latitude="lat", longitude="lon")),
    "numeric only": ("sample_numeric_iid.csv", iid("numeric_0", False, [f"numeric_{i}" for i in range(1, 10)])),
    "categorical only": (
        "sample_categorical_iid.csv", iid("categorical_0", True, [f"categorical_{i}" for i in range(1, 10)]),
    ),
}


def city_places(spark):
    values = [F.lit(float(i)).alias(c) for i, c in enumerate(place.place_columns())]
    cities = [(lat, lon) for lat, lon in synth.PLACES.values()]
    return spark.createDataFrame(cities, "latitude double, longitude double").select("*", *values)


@pytest.mark.parametrize("case", CASES)
def test_train_and_predict(spark, samples, case):
    name, roles = CASES[case]
    df = files.load(spark, samples[name])
    trained = train(roles, df, FEW, places=city_places(spark) if roles.is_spatial else None)
    scored, messages = try_predict(trained, df.drop(roles.target))
    assert scored.count() == df.count()
    assert scored.filter(F.col(roles.target).isNull()).isEmpty()
    assert dict(scored.dtypes)[roles.target] == ("string" if roles.target_is_categorical else "double")
    assert set(scored.columns) == set(df.columns)
    if roles.target_is_categorical:
        assert trained.num_classes == df.select(roles.target).distinct().count()


@pytest.fixture(scope="module")
def learnable(spark):
    """A number and a class that follow from the features."""
    df = spark.range(2000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"),
        (F.col("id") % 10).cast("double").alias("v"),
    )
    return df.withColumns(
        {
            "y": F.when(F.col("c") == "x", 100.0).otherwise(10.0) + F.col("v"),
            "kind": F.when(F.col("v") > 4, "high").when(F.col("c") == "x", "low").otherwise("mid"),
        }
    )


@pytest.mark.parametrize("joins", ["broadcast", "shuffle"])
def test_predictions_belong_to_their_rows(learnable, joins, request):
    if joins == "shuffle":
        request.getfixturevalue("tiny_tables")
        request.getfixturevalue("no_broadcast")
    trained = train(Roles(target="y", features=("c", "v")), learnable, TrainParams(trees=20, depth=4, step=0.5))
    scored = predict(trained, learnable.repartition(5), "prediction")
    assert scored.count() == 2000
    worst = scored.agg(F.max(F.abs(F.col("prediction") - F.col("y")) / F.col("y"))).first()[0]
    assert worst < 0.1
    assert scored.columns == [*learnable.columns, "prediction"]


@pytest.mark.parametrize("method", ["forest", "one_vs_rest", "softmax"])
def test_multiclass(learnable, method):
    params = TrainParams(trees=10, depth=4, multiclass=method)
    trained = train(Roles(target="kind", target_is_categorical=True, features=("c", "v")), learnable, params)
    scored = predict(trained, learnable, "guess")
    assert scored.filter("guess <> kind").isEmpty()
    assert {n for n, _ in [(r["name"], 0) for r in importance_table(trained).collect()]} <= {"v", "ordinal_c", "other features"}


def test_codes_are_split_as_categories(learnable):
    roles = Roles(target="y", features=("c", "v"))
    plain = ModelRoles(feature_roles(roles, learnable), TargetRole("y"))
    trained = train(roles, learnable, FEW, model_roles=plain)
    assert trained.vector.feature_names == ["v", "ordinal_c"]
    assert "in {" in trained.model.trees[0].toDebugString


def test_stored_input_gives_the_same_model(learnable):
    roles = Roles(target="y", features=("c", "v"))
    plain, stored = train(roles, learnable, FEW), train(roles, learnable, FEW, store_input=True)
    assert stored.vector == plain.vector
    gap = predict(plain, learnable, "a").join(predict(stored, learnable, "b").select("id", "b"), "id")
    assert gap.filter("abs(a - b) > 1e-6").isEmpty()


def test_missing_values_and_unseen_levels(spark, learnable):
    holes = learnable.withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v"))).withColumn(
        "w", F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("v"))
    )
    trained = train(Roles(target="y", features=("c", "v", "w")), holes, FEW)
    assert "is_missing_v" in trained.vector.feature_names and "is_missing_w" in trained.vector.feature_names
    odd = spark.createDataFrame([("new", None, float("inf")), (None, 1.0, None)], "c string, v double, w double")
    assert predict(trained, odd).filter("y is not null").count() == 2


def test_rows_without_label_or_weight_are_counted(learnable):
    df = learnable.withColumn("y", F.when(F.col("id") >= 10, F.col("y"))).withColumn(
        "g", F.when(F.col("id") % 100 != 50, F.col("c"))
    )
    trained = train(Roles(target="y", features=("c", "v"), groups=("g",)), df, FEW)
    assert trained.dropped_rows == 30


def test_retraining_keeps_codes(learnable):
    roles = Roles(target="y", features=("c", "v"))
    first = train(roles, learnable.filter("c = 'y'"), FEW)
    second = train(roles, learnable, FEW, previous=first)
    codes = second.features.transform(learnable).select("c", "ordinal_c").distinct().collect()
    assert {r["c"]: r["ordinal_c"] for r in codes} == {"y": 0, "x": 1}
    assert second.model_roles == first.model_roles


def test_scaled_targets_need_their_column(learnable):
    roles = Roles(target="y", features=("c", "v"))
    model_roles = ModelRoles(feature_roles(roles, learnable), TargetRole("y", scale_by_category="c"))
    trained = train(roles, learnable, FEW, model_roles=model_roles)
    assert predict(trained, learnable, "p").filter("abs(p - y) > 20").isEmpty()
    scored, messages = try_predict(trained, learnable.drop("c"))
    assert scored is None and any("missing column c" in m for m in messages)
    with pytest.raises(ValueError):
        predict(trained, learnable.drop("c"))
    with pytest.raises(ValueError):
        TargetRole("y", scale_by_category="c", scale_by_number="v")


def test_messages_name_unused_columns(learnable):
    trained = train(Roles(target="y", features=("v",)), learnable, FEW)
    _, messages = try_predict(trained, learnable.drop("y"), "p")
    assert messages == ["unused columns: ['id', 'c', 'kind']"]
    with pytest.raises(ValueError):
        train(Roles(target="y", features=("nope",)), learnable, FEW)
    with pytest.raises(ValueError):
        train(Roles(target="y"), learnable, FEW)


def test_roles():
    a = Roles(target="y", groups=["g"], features=["a"])
    assert a.same_problem(Roles(target="y", groups=("g",), features=("b",)))
    assert not a.same_problem(Roles(target="y", features=("a",)))
    assert weight_roles(Roles(target="c", target_is_categorical=True, groups=("g",))).groups == ("g", "c")
    assert weight_roles(Roles(target="c", target_is_categorical=True)) == WeightRoles(groups=("c",))
    assert Roles(target="y", date="d", latitude="a", longitude="o", features=("f",)).used_for_prediction == [
        "f", "d", "a", "o",
    ]
    with pytest.raises(ValueError):
        Roles().require_features()


def test_contract(spark):
    df = spark.createDataFrame([("2021-01-01", 1.0), ("bad", None)], "d string, x double")
    needs = [("d", "date", "date"), ("x", "feature", "numeric"), ("x", "feature", "categorical"), ("n", "target", "numeric")]
    rows = [tuple(r) for r in contract.input_contract(df, needs).collect()]
    assert rows == [
        ("d", "date", True, True, 0, 1),
        ("x", "feature", True, True, 1, None),
        ("x", "feature", True, False, 1, None),
        ("n", "target", False, False, None, None),
    ]


def test_importance_buckets(spark):
    rows = [("a", 0.7), ("b", 0.2), ("c", 0.06), ("d", 0.04)]
    df = spark.createDataFrame(rows, "name string, importance double")
    got = {r["name"]: round(r["importance"], 9) for r in importance_buckets(df).collect()}
    assert got == {"a": 0.7, "b": 0.2, "other features": 0.1}
    none = df.withColumn("importance", F.lit(0.0))
    assert [tuple(r) for r in importance_buckets(none).collect()] == [("other features", 4.0)]


def test_preview_order(learnable):
    roles = Roles(target="y", groups=("c",), features=("v", "c"))
    df = learnable.withColumn("prediction", F.col("y"))
    out = prediction_preview(df, roles, n=5)
    assert out.columns == ["prediction", "y", "c", "v"] and out.count() == 5
    with pytest.raises(ValueError):
        prediction_preview(learnable, roles)


def test_registry(spark, learnable, tmp_path):
    store = Registry(spark, str(tmp_path / "store"))
    assert store.list_models().isEmpty()
    roles = Roles(target="kind", target_is_categorical=True, groups=("c",), features=("c", "v"))
    trained = train(roles, learnable, FEW)
    key = store.write_model(trained, call_limit=2)
    assert len(key) == 24 and set(key) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    again = store.read_model(key)
    assert again.roles == roles and again.model_roles == trained.model_roles
    before, after = predict(trained, learnable, "p"), predict(again, learnable, "p")
    assert before.exceptAll(after).isEmpty()
    assert store.record_call(key) == 1 and store.record_call(key) == 0
    with pytest.raises(PermissionError):
        store.record_call(key)
    with pytest.raises(KeyError):
        store.read_model("nope")
    second = store.write_model(train(Roles(target="y", features=("v",)), learnable, FEW))
    listed = store.list_models().collect()
    assert [r["model_key"] for r in listed] == [second, key]
    assert [r["remaining_calls"] for r in listed] == [100, 0]
    assert new_key() != new_key()


def test_registry_keeps_large_tables(spark, learnable, tmp_path, tiny_tables):
    store = Registry(spark, str(tmp_path / "store"))
    trained = train(Roles(target="y", features=("c", "v")), learnable, FEW)
    again = store.read_model(store.write_model(trained))
    assert not again.features.steps[1].table.small
    assert predict(trained, learnable, "p").exceptAll(predict(again, learnable, "p")).isEmpty()


def test_quota_of_a_busy_model(spark):
    models = spark.createDataFrame([("a", 100), ("b", 100)], "model_key string, call_limit bigint")
    calls = spark.range(120).selectExpr("if(id % 3 < 2, 'a', 'z') AS model_key")
    assert {r["model_key"]: r["remaining_calls"] for r in quota(models, calls).collect()} == {"a": 20, "b": 100}


def test_model_does_not_depend_on_files(spark):
    df = spark.range(12_000).select(
        (F.rand(1) * 100).alias("x"), F.concat(F.lit("g"), F.col("id") % 300).alias("g"), (F.randn(2) + F.col("id") % 7).alias("y")
    ).cache()
    roles = iid("y", False, ("x", "g"))
    params = TrainParams(trees=2, depth=3, partitions=4)
    found = []
    for parts in (1, 4, 9):
        trained = train(roles, df.repartition(parts), params)
        assert trained.vector.bins_needed == 301  # nominal, however many
        found.append(predict(trained, df, "p").agg(F.sum("p")).first()[0])
    assert found[0] == pytest.approx(found[1], rel=1e-12) and found[0] == pytest.approx(found[2], rel=1e-12)
    by_order = train(roles, df, TrainParams(trees=2, depth=3, partitions=4, ordered_categories=("g",)))
    assert by_order.vector.bins_needed == 2


def test_null_labels_are_no_class(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2] if i % 5 else None) for i in range(60)], "x double, y string")
    trained = train(iid("y", True, ("x",)), df, FEW)
    assert trained.num_classes == 2 and trained.dropped_rows == 12
    assert type(trained.model).__name__ == "GBTClassificationModel"


def test_predict_without_its_date(spark):
    df = spark.range(40).selectExpr("cast(id as double) as x", "timestamp_seconds(id * 86400) as d", "cast(id as double) as y")
    trained = train(Roles(target="y", date="d", features=("x",)), df, FEW)
    with pytest.raises(ValueError, match="missing column d"):
        predict(trained, df.drop("d"))


def test_concurrent_callers_share_the_quota_exactly(spark, learnable, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = Registry(spark, str(tmp_path / "store with space"))
    key = store.write_model(train(Roles(target="y", features=("v",)), learnable, FEW), call_limit=5)

    def call(_):
        try:
            return store.record_call(key)
        except PermissionError:
            return None

    with ThreadPoolExecutor(20) as pool:
        got = list(pool.map(call, range(20)))
    assert sorted(x for x in got if x is not None) == [0, 1, 2, 3, 4]
    assert store.remaining_calls(key) == 0 and store.calls().filter(F.col("model_key") == key).count() == 5


@pytest.mark.parametrize("dies_in", ["save_trained", "rename"])
def test_a_model_that_fails_midway_is_not_listed(spark, learnable, tmp_path, monkeypatch, dies_in):
    from coppice.plans import registry as module

    store = Registry(spark, str(tmp_path / "store"))
    trained = train(Roles(target="y", features=("v",)), learnable, FEW)
    with monkeypatch.context() as patched:
        if dies_in == "save_trained":
            save = module.save_trained

            def dying(*a):
                save(*a)
                raise RuntimeError("lost")

            patched.setattr(module, "save_trained", dying)
        else:
            def hidden_only(self, name, text):
                self.files.mkdirs(self._of(name).getParent())
                self.files.create(self._path(self._of(name).getParent(), "_half"), False).close()
                raise RuntimeError("lost")

            patched.setattr(module.Folder, "publish", hidden_only)
        with pytest.raises(RuntimeError):
            store.write_model(trained)
    assert store.models().isEmpty() and store.list_models().isEmpty()
    key = store.write_model(trained)
    assert [r["model_key"] for r in store.models().collect()] == [key]
