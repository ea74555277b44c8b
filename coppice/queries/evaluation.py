"""Evaluation and exploration datasets, with predictions SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import scale
from coppice.operators.lookup import attach, freeze
from coppice.operators.stats import distinct_groups
from coppice.plans import evaluate
from coppice.plans.model import prediction_preview
from coppice.plans.roles import Roles
from coppice.queries.base import query, r, rounded, table
from coppice.queries.ingest import draw
from coppice.session import scratch_path
from coppice.sources import files

# Numeric prediction: the mean price of the order's priority, in whole units.
PREDICTED = """(SELECT *, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS prediction FROM orders)"""
NUMERIC = Roles(
    target="o_totalprice", date="o_orderdate", groups=("o_orderpriority",), features=("o_custkey", "o_orderpriority")
)


def predicted(spark, sf):
    df = table(spark, sf, "orders")
    means = freeze(scale.mean_std(df, "o_totalprice", "o_orderpriority"), ["group"])
    df = attach(df, means, {"group": "o_orderpriority"}, {"mean": "prediction"})
    return df.withColumn("prediction", F.round("prediction"))


# Categorical prediction: urgent if expensive.
CLASSED = """(SELECT *, CASE WHEN o_totalprice > 300000 THEN '1-URGENT'
                             WHEN o_totalprice > 20000 THEN '5-LOW' END AS prediction FROM orders)"""
CLASSES = Roles(target="o_orderpriority", target_is_categorical=True, features=("o_custkey", "o_totalprice"))


def classed(spark, sf):
    guess = F.when(F.col("o_totalprice") > 300000, "1-URGENT").when(F.col("o_totalprice") > 20000, "5-LOW")
    return table(spark, sf, "orders").withColumn("prediction", guess)


@query(
    "categorical_error",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority = prediction THEN 0 ELSE 1 END AS error FROM {CLASSED}""",
)
def categorical_error(spark, sf):
    return evaluate.categorical_error(classed(spark, sf), "o_orderpriority", "prediction").select("o_orderkey", "error")


@query(
    "numeric_error",
    """SELECT l_orderkey, l_linenumber, """
    + r("(l_tax - l_discount) / nullif(l_discount, 0)")
    + " AS error FROM lineitem",
)
def numeric_error(spark, sf):
    df = evaluate.numeric_error(table(spark, sf, "lineitem"), "l_discount", "l_tax")
    return df.select("l_orderkey", "l_linenumber", rounded("error").alias("error"))


# Orders of a nation lie at its latitude and longitude.
PLACED = f"""(SELECT o.*, (c_nationkey * 3 - 36)::DOUBLE AS lat, (c_nationkey * 7 - 84)::DOUBLE AS lon, n_name
              FROM {PREDICTED} o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PLACED_ROLES = Roles(target="o_totalprice", latitude="lat", longitude="lon", features=("o_custkey", "o_orderpriority"))


def placed(spark, sf):
    key = F.col("c_nationkey").cast("double")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", (key * 3 - 36).alias("lat"), (key * 7 - 84).alias("lon"), "n_name"
    )
    return predicted(spark, sf).join(located, F.col("o_custkey") == F.col("c_custkey"))


@query(
    "spatial_eval",
    f"""SELECT o_custkey, o_orderpriority, lat, lon, o_totalprice, prediction,
               {r("(prediction - o_totalprice) / nullif(o_totalprice, 0)")} AS error FROM {PLACED}""",
)
def spatial_eval(spark, sf):
    df = evaluate.spatial_evaluation(placed(spark, sf), PLACED_ROLES)
    return df.withColumn("error", rounded("error"))


@query(
    "spatial_eval_classes",
    f"""SELECT o_custkey, o_totalprice, (o_custkey % 90)::DOUBLE AS lat, (o_custkey % 180)::DOUBLE AS lon,
               o_orderpriority, prediction, CASE WHEN o_orderpriority = prediction THEN 0 ELSE 1 END AS error
        FROM {CLASSED}""",
)
def spatial_eval_classes(spark, sf):
    customer = F.col("o_custkey")
    df = classed(spark, sf).withColumns(
        {"lat": (customer % 90).cast("double"), "lon": (customer % 180).cast("double")}
    )
    roles = Roles(
        target="o_orderpriority", target_is_categorical=True, latitude="lat", longitude="lon",
        features=("o_custkey", "o_totalprice"),
    )
    return evaluate.spatial_evaluation(df, roles)


@query(
    "eval_gate",
    """SELECT 'unique' AS input, count(*) = count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS ok FROM lineitem
       UNION ALL
       SELECT 'repeated', count(*) = count(DISTINCT (l_returnflag, l_quantity)) FROM lineitem
       UNION ALL SELECT 'no target', false""",
)
def eval_gate(spark, sf):
    df = table(spark, sf, "lineitem")
    inputs = {
        "unique": (df, Roles(target="l_extendedprice", features=("l_orderkey", "l_linenumber", "l_partkey"))),
        "repeated": (df, Roles(target="l_extendedprice", features=("l_returnflag", "l_quantity"))),
        "no target": (df.drop("l_tax"), Roles(target="l_tax", features=("l_orderkey", "l_linenumber"))),
    }
    rows = []
    for name, (data, roles) in inputs.items():
        try:
            evaluate.check_evaluation(data, roles)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "input string, ok boolean")


@query(
    "group_slice",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE (l_returnflag, l_linestatus) = (SELECT (l_returnflag, l_linestatus) FROM lineitem ORDER BY 1 LIMIT 1)""",
)
def group_slice(spark, sf):
    df = table(spark, sf, "lineitem")
    groups = ["l_returnflag", "l_linestatus"]
    first = distinct_groups(df, groups).first().asDict()
    return evaluate.group_slice(df, first).select("l_orderkey", "l_linenumber", "l_quantity")


@query("scatter_set", "SELECT o_totalprice, o_custkey, o_orderpriority FROM orders")
def scatter_set(spark, sf):
    return evaluate.scatter_set(table(spark, sf, "orders"), NUMERIC, ["o_orderkey"], "o_custkey", "o_orderpriority")


@query(
    "scatter_set_capped",
    f"""SELECT o_totalprice, o_custkey FROM orders
        WHERE {draw("sample/7", "o_orderkey")} < 5000 / (SELECT count(*) FROM orders)::DOUBLE""",
)
def scatter_set_capped(spark, sf):
    return evaluate.scatter_set(table(spark, sf, "orders"), NUMERIC, ["o_orderkey"], "o_custkey", cap=5000)


@query(
    "series_set",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, o_orderpriority FROM orders",
)
def series_set(spark, sf):
    df = evaluate.series_set(table(spark, sf, "orders"), NUMERIC, "o_orderpriority")
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("spatial_set", f"SELECT o_custkey, o_orderpriority, lat, lon, o_totalprice, n_name FROM {PLACED}")
def spatial_set(spark, sf):
    return evaluate.spatial_set(placed(spark, sf), PLACED_ROLES, "n_name")


@query(
    "actual_vs_pred_ts",
    f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice AS value, false AS is_prediction
        FROM {PREDICTED} UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), prediction, true FROM {PREDICTED}""",
)
def actual_vs_pred_ts(spark, sf):
    df = evaluate.series_evaluation(predicted(spark, sf), NUMERIC)
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "actual_vs_pred_iid",
    f"""SELECT o_totalprice, o_totalprice AS value, false AS is_prediction FROM {PREDICTED}
        UNION ALL SELECT o_totalprice, prediction, true FROM {PREDICTED}""",
)
def actual_vs_pred_iid(spark, sf):
    return evaluate.iid_evaluation(predicted(spark, sf), NUMERIC)


@query(
    "confusion_counts",
    f"SELECT o_orderpriority, prediction, count(*) AS n FROM {CLASSED} GROUP BY ALL",
)
def confusion_counts(spark, sf):
    return evaluate.confusion_counts(classed(spark, sf), "o_orderpriority")


@query(
    "target_histogram",
    """SELECT o_orderpriority,
              least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n
       FROM orders CROSS JOIN (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       GROUP BY ALL""",
)
def target_histogram(spark, sf):
    return evaluate.histogram(table(spark, sf, "orders"), "o_totalprice", 20, ["o_orderpriority"])


@query(
    "eval_histogram",
    f"""WITH v AS (SELECT o_totalprice AS value, false AS is_prediction FROM {PREDICTED}
                   UNION ALL SELECT prediction, true FROM {PREDICTED})
        SELECT is_prediction, least(floor((value - lo) / ((hi - lo) / 15)), 14)::BIGINT AS bin, count(*) AS n
        FROM v CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM v) GROUP BY ALL""",
)
def eval_histogram(spark, sf):
    df = evaluate.iid_evaluation(predicted(spark, sf), NUMERIC)
    return evaluate.histogram(df, "value", 15, ["is_prediction"])


@query(
    "prediction_preview",
    f"""SELECT * FROM (
          SELECT prediction, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, o_custkey
          FROM {PREDICTED} ORDER BY ALL LIMIT 100)""",
)
def preview_of_predictions(spark, sf):
    df = prediction_preview(predicted(spark, sf), NUMERIC)
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "prediction_export_text",
    "SELECT doc_id, text, length(text)::DOUBLE AS prediction FROM documents",
)
def prediction_export_text(spark, sf):
    path = scratch_path(spark, "predictions")
    scored = table(spark, sf, "documents").select("doc_id", "text", F.length("text").cast("double").alias("prediction"))
    files.write_csv(scored, path)
    return files.read_csv(spark, path, scored.schema)


@query("prediction_export", f"SELECT o_orderkey, o_totalprice, prediction FROM {PREDICTED}")
def prediction_export(spark, sf):
    path = scratch_path(spark, "predictions")
    files.write_csv(predicted(spark, sf).select("o_orderkey", "o_totalprice", "prediction"), path)
    return files.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, prediction double")
