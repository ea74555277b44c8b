"""Training, scoring and the model registry."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from coppice.plans import registry
from coppice.plans.model import TrainParams, importance_table, predict, train, try_predict
from coppice.plans.roles import Roles
from coppice.queries.base import query, r, rounded, table
from coppice.queries.profiles import labelled
from coppice.queries.targets import MODELS_SQL, call_rows, model_rows, order_rows
from coppice.session import scratch_path, store_columns

FULL = TrainParams(partitions=8)
# One split on a category of two levels: what the model says can be stated in SQL.
SPLIT = TrainParams(trees=1, depth=1, partitions=8)

ORDER_ROLES = Roles(
    target="o_totalprice",
    date="o_orderdate",
    groups=("c_mktsegment",),
    features=("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_acctbal", "c_nationkey"),
)


@query("train_predict_regression", "SELECT o_orderkey, TRUE AS finite, TRUE AS better_than_mean FROM orders JOIN customer ON o_custkey = c_custkey")
def train_predict_regression(spark, sf):
    """Prices of orders: dates, categories, recency and group weights, log target.

    Emits every order with two facts: its prediction is finite, and over all
    orders the squared error of the logarithm is below that of its mean.
    """
    df = store_columns(order_rows(spark, sf).drop("o_custkey", "c_custkey"))  # one join for training and scoring
    trained = train(ORDER_ROLES, df, FULL)
    scored = predict(trained, df.withColumn("actual", F.col("o_totalprice")).drop("o_totalprice"), "prediction")
    scored = store_columns(scored.select("o_orderkey", "actual", "prediction"))
    error = F.log1p("prediction") - F.log1p("actual")
    facts = scored.agg((F.avg(error * error) < F.var_pop(F.log1p("actual"))).alias("better_than_mean"))
    finite = F.coalesce(F.abs("prediction") < float("inf"), F.lit(False))
    return scored.select("o_orderkey", finite.alias("finite")).join(F.broadcast(facts))


@query("train_predict_binary", "SELECT doc_id, TRUE AS known FROM documents")
def train_predict_binary(spark, sf):
    """Quality of the labelled documents, predicted for all documents; rows without a label are not learned from."""
    docs = labelled(spark, sf)
    roles = Roles(target="grade", target_is_categorical=True, features=("lang", "source", "n_chars"))
    trained = train(roles, docs, FULL, store_input=True)
    scored, _ = try_predict(trained, docs, "prediction")
    return scored.select("doc_id", F.col("prediction").isin("good", "bad").alias("known"))


@query("train_predict_multiclass", "SELECT l_orderkey, l_linenumber, TRUE AS known FROM lineitem")
def train_predict_multiclass(spark, sf):
    df = table(spark, sf, "lineitem")
    roles = Roles(
        target="l_returnflag",
        target_is_categorical=True,
        features=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"),
    )
    trained = train(roles, df, FULL)
    known = F.col("prediction").isin("A", "N", "R").alias("known")
    return predict(trained, df, "prediction").select("l_orderkey", "l_linenumber", known)


def split_model(spark, sf, target, categorical=False, rows=None):
    df = table(spark, sf, "lineitem") if rows is None else rows
    roles = Roles(target=target, target_is_categorical=categorical, features=("l_linestatus",))
    return train(roles, df, SPLIT), df


MEANS_SQL = f"""SELECT l_orderkey, l_linenumber, {r("exp(m) - 1", 2)} AS prediction FROM lineitem
                JOIN (SELECT l_linestatus, avg(ln(1 + l_extendedprice)) AS m FROM lineitem GROUP BY 1) USING (l_linestatus)"""


@query("split_regression", MEANS_SQL)
def split_regression(spark, sf):
    trained, df = split_model(spark, sf, "l_extendedprice")
    scored = predict(trained, df, "prediction")
    return scored.select("l_orderkey", "l_linenumber", rounded("prediction", 2).alias("prediction"))


def majority_sql(label: str) -> str:
    """Per line status the label with most weight, where all labels weigh the same in total."""
    return f"""SELECT l_orderkey, l_linenumber, prediction FROM lineitem JOIN (
          SELECT l_linestatus, arg_max(label, weight) AS prediction FROM (
            SELECT l_linestatus, label, count(*) / sum(count(*)) OVER (PARTITION BY label) AS weight
            FROM (SELECT l_linestatus, {label} AS label FROM lineitem) WHERE label IS NOT NULL GROUP BY 1, 2)
          GROUP BY 1) USING (l_linestatus)"""


SIZED = """CASE WHEN l_quantity > if(l_linestatus = 'F', 20, 40) THEN 'large'
                WHEN l_quantity > if(l_linestatus = 'F', 10, 30) THEN 'medium' ELSE 'small' END"""


@query("split_multiclass", majority_sql(SIZED))
def split_multiclass(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("sized", F.expr(SIZED))
    trained, df = split_model(spark, sf, "sized", True, rows)
    return predict(trained, df, "prediction").select("l_orderkey", "l_linenumber", "prediction")


@query("split_softmax", majority_sql(SIZED))
def split_softmax(spark, sf):
    """One round of the softmax ensemble with one split per class: again the label with most weight."""
    rows = table(spark, sf, "lineitem").withColumn("sized", F.expr(SIZED))
    roles = Roles(target="sized", target_is_categorical=True, features=("l_linestatus",))
    trained = train(roles, rows, replace(SPLIT, multiclass="softmax"))
    return predict(trained, rows, "prediction").select("l_orderkey", "l_linenumber", "prediction")


@query("softmax_multiclass", "SELECT l_orderkey, l_linenumber, TRUE AS known, TRUE AS better_than_forest FROM lineitem")
def softmax_multiclass(spark, sf):
    """Return flags by boosted trees of all classes, which are right for more rows than a forest of as many trees."""
    df = table(spark, sf, "lineitem").withColumn("days", F.datediff("l_shipdate", F.lit("1992-01-01")))
    roles = Roles(target="l_returnflag", target_is_categorical=True, features=("l_quantity", "l_extendedprice", "days", "l_linestatus"))
    scored = df
    for method in ("softmax", "forest"):
        scored = predict(train(roles, df, TrainParams(trees=10, partitions=8, multiclass=method)), scored, method)
    scored = store_columns(scored.select("l_orderkey", "l_linenumber", "l_returnflag", "softmax", "forest"))
    right = [F.count_if(F.col(c) == F.col("l_returnflag")) for c in ("softmax", "forest")]
    facts = scored.agg((right[0] >= right[1]).alias("better_than_forest"))
    known = F.col("softmax").isin("A", "N", "R").alias("known")
    return scored.select("l_orderkey", "l_linenumber", known).join(F.broadcast(facts))


DISCOUNTED = "CASE WHEN l_quantity % 7 = 0 THEN NULL WHEN l_discount > 0.02 THEN 'yes' ELSE 'no' END"


@query("split_binary", majority_sql(DISCOUNTED))
def split_binary(spark, sf):
    """Two classes with some labels missing: null is not a class."""
    rows = table(spark, sf, "lineitem").withColumn("discounted", F.expr(DISCOUNTED))
    trained, df = split_model(spark, sf, "discounted", True, rows)
    scored, _ = try_predict(trained, df, "prediction")
    return scored.select("l_orderkey", "l_linenumber", "prediction")


@query("importance_buckets", "SELECT 'ordinal_l_linestatus' AS name, 1.0::DOUBLE AS importance FROM lineitem LIMIT 1")
def importance_buckets(spark, sf):
    trained, _ = split_model(spark, sf, "l_extendedprice")
    return importance_table(trained)


@query("registry_roundtrip", f"SELECT *, 99::BIGINT AS remaining_calls FROM ({MEANS_SQL})")
def registry_roundtrip(spark, sf):
    """Train, save, list, count a call, load and predict."""
    trained, df = split_model(spark, sf, "l_extendedprice")
    store = registry.Registry(spark, scratch_path(spark, "registry"))
    key = store.write_model(trained)
    remaining = store.record_call(key)
    scored = predict(store.read_model(key), df, "prediction")
    return scored.select(
        "l_orderkey", "l_linenumber", rounded("prediction", 2).alias("prediction"),
        F.lit(remaining).cast("bigint").alias("remaining_calls"),
    )


@query("registry_price_model", "SELECT o_orderkey, TRUE AS same, TRUE AS whole, TRUE AS folded, 1 AS listed FROM orders JOIN customer ON o_custkey = c_custkey")
def registry_price_model(spark, sf):
    """The price model with its date, groups and logarithm, saved and loaded.

    Emits for every order that the loaded model predicts the same, and of the
    loaded model's importances that they add up to 1 and that no feature with a
    tenth or less stands alone, with how many models are listed.
    """
    df = store_columns(order_rows(spark, sf))
    trained = train(ORDER_ROLES, df, TrainParams(trees=5, partitions=8))
    store = registry.Registry(spark, scratch_path(spark, "registry"))
    loaded = store.read_model(store.write_model(trained))
    both = predict(loaded, predict(trained, df, "before"), "after")
    buckets = importance_table(loaded)
    facts = buckets.agg(
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("whole"),
        (F.coalesce(F.min(F.when(F.col("name") != "other features", F.col("importance"))), F.lit(1.0)) > 0.1).alias("folded"))
    listed = store.models().agg(F.count(F.lit(1)).cast("int").alias("listed"))
    same = F.col("before").eqNullSafe(F.col("after")).alias("same")
    return both.select("o_orderkey", same).join(F.broadcast(facts)).join(F.broadcast(listed))


QUOTA_SQL = f"""(SELECT model_key, 100 - count(c.ts) AS remaining_calls FROM {MODELS_SQL} m
                 LEFT JOIN (SELECT 'M' || user_id AS model_key, ts FROM events WHERE event_type = 'purchase') c
                 USING (model_key) GROUP BY model_key)"""


@query("quota_remaining", f"SELECT * FROM {QUOTA_SQL}")
def quota_remaining(spark, sf):
    return registry.quota(model_rows(spark, sf), call_rows(spark, sf))


@query(
    "registry_list",
    f"""SELECT model_key, epoch_us(created_at) AS created_us, target, target_is_categorical, date, remaining_calls
        FROM {MODELS_SQL} JOIN {QUOTA_SQL} USING (model_key)""",
)
def registry_list(spark, sf):
    df = registry.list_models(model_rows(spark, sf), call_rows(spark, sf))
    return df.select(
        "model_key", F.unix_micros("created_at").alias("created_us"), "target", "target_is_categorical", "date",
        "remaining_calls",
    )
