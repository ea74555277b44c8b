"""What training reads, and how it deals rows."""

import pytest
from pyspark.sql import functions as F

from coppice import Roles, TrainParams, predict, train
from coppice.operators.dates import conform_date
from coppice.operators.scale import Log, Ratio, ZScore
from coppice.operators.weight import Balance, Decay
from coppice.operators.encode import Ordinal
from coppice.plans import model as model_module
from coppice.plans.model import COPIES, WEIGHT, dealt_rows
from coppice.plans.roles import ModelRoles, TargetRole, feature_roles, infer_model_roles, weight_roles
from coppice.plans.survey import Survey
from coppice.plans.assemble import weight_steps


@pytest.fixture(scope="module")
def sales(spark):
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 31 != 0, "y").alias("c.d"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 10).cast("double")).alias("v"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 40).cast("int")).cast("string").alias("day"),
        F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("g"))
    return df.withColumn("y", F.when(F.col("id") % 11 != 0, F.when(F.col("`c.d`") == "x", 100.0).otherwise(10.0) + (F.col("id") % 10)))


ROLES = Roles(target="y", date="day", groups=("g",), features=("c.d", "v"))


def test_training_reads_its_input_three_times(spark, sales, tmp_path):
    """Every scan of the input is counted by a task-side accumulator: one count per row that is read."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    sales.write.parquet(str(tmp_path / "sales"))
    plain = spark.read.parquet(str(tmp_path / "sales")).withColumnRenamed("c.d", "cd")
    counted = plain.mapInArrow(count, plain.schema).withColumnRenamed("cd", "c.d")
    trained = train(ROLES, counted, TrainParams(trees=2, depth=2, partitions=4))
    assert reads.value <= 3 * 900
    assert trained.dropped_rows == sales.filter("y is null").count()
    assert trained.model_roles.target == TargetRole("y", False, True, "c.d", None)
    assert trained.model_roles == infer_model_roles(ROLES, conform_date(sales, "day"))
    assert predict(trained, sales, "p").filter("p is null").isEmpty()


def test_steps_built_from_a_survey_are_those_fitted_on_rows(sales):
    df = conform_date(sales, "day").withColumn("log1p_y", F.log1p("y"))
    steps = [Ordinal("c.d"), Ordinal("g"), Log("y"), ZScore("log1p_y", "g"), Ratio("y", "v"), Balance("day"), Balance("g"), Decay("day", 0.2)]
    survey = Survey(df, "y")
    totals = survey.totals(steps, {})
    known = df.filter("y is not null")
    with survey.levels(steps, {}, {}, totals) as found:
        built = [s.build(found) for s in steps]
    for step, one in zip(steps, built):
        two = step.fit(known)
        assert one.output_columns == two.output_columns
        a, b = ([float("nan") if r[0] is None else r[0] for r in x.transform(known).orderBy("id").select(
            F.col("`" + x.output_columns[-1] + "`")).collect()] for x in (one, two))
        assert a == pytest.approx(b, rel=1e-12, nan_ok=True)


def test_two_hot_rows_fill_the_tasks_evenly(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, -1.0).when(F.col("id") % 3 == 1, -2.0).otherwise(F.col("id").cast("double")).alias("v"),
        F.lit("a").alias("c"), F.lit(1.0).alias("y"))
    roles = Roles(target="y", features=("v", "c"))
    model_roles = ModelRoles(feature_roles(roles, rows), TargetRole("y"), weight_roles(roles))
    dealt = dealt_rows(rows, model_roles, weight_steps(model_roles.weight).fit(rows), TrainParams(partitions=8), None, 20_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * sum(sizes) / 8
    assert dealt.agg(F.sum(COPIES)).first()[0] == 20_000 and dealt.agg(F.sum(WEIGHT)).first()[0] == pytest.approx(20_000)
    assert {r[COPIES] for r in dealt.filter("v < 0").collect()} == {6667}


def test_models_of_collapsed_rows_equal_those_of_all_rows(sales, monkeypatch):
    repeated = sales.unionByName(sales.filter("id % 5 = 0")).unionByName(sales.filter("id % 9 = 0"))
    params = TrainParams(trees=5, depth=3, partitions=4)
    collapsed = predict(train(ROLES, repeated, params), sales, "a")
    monkeypatch.setattr(model_module.TrainParams, "draws_rows", lambda self, n: True)
    apart = predict(train(ROLES, repeated, params), sales, "b").select("id", "b")
    assert collapsed.join(apart, "id").filter("abs(a - b) > 1e-9 * abs(a)").isEmpty()


def test_partitions_follow_the_rows(spark, monkeypatch):
    rows = spark.range(100).select(F.col("id").cast("double").alias("v"), F.lit("a").alias("c"), F.lit(1.0).alias("y"))
    roles = Roles(target="y", features=("v", "c"))
    model_roles = ModelRoles(feature_roles(roles, rows), TargetRole("y"), weight_roles(roles))
    weight = weight_steps(model_roles.weight).fit(rows)
    for n, expected in [(100, 32), (40_000_000, 80)]:
        assert dealt_rows(rows, model_roles, weight, TrainParams(), None, n).rdd.getNumPartitions() == expected
    for params, width, expected in [(TrainParams(partitions=8), 1, 80), (TrainParams(partitions=100), 1, 100), (TrainParams(partitions=8), 128, 153)]:
        assert dealt_rows(rows, model_roles, weight, params, None, 40_000_000, width).rdd.getNumPartitions() == expected


def test_rows_to_draw_from_are_counted(spark):
    rows = spark.range(6000).selectExpr("cast(id % 2 as double) as v", "concat('k', id % 3) as y", "concat('g', cast(id >= 5400 as int)) as g")
    roles = Roles(target="y", target_is_categorical=True, features=("v",), groups=("g",))
    model_roles = ModelRoles(feature_roles(roles, rows), TargetRole("y", is_categorical=True), weight_roles(roles))
    weight = weight_steps(model_roles.weight).fit(rows)
    dealt = dealt_rows(rows, model_roles, weight, TrainParams(partitions=2), 3, 6000).collect()
    # two numbers, three classes and one weight per class and group
    assert sorted(r[COPIES] for r in dealt) == [100] * 6 + [900] * 6
    assert sum(r[WEIGHT] for r in dealt) == pytest.approx(weight.transform(rows).agg(F.sum(weight.output_columns[-1])).first()[0])
