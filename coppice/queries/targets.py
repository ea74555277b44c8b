"""Features, targets, weights and the input contract, assembled."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import scale, steps
from coppice.operators.dates import conform_date
from coppice.plans import assemble, contract
from coppice.plans.registry import same_problem_models
from coppice.plans.roles import FeatureRoles, ModelRoles, TargetRole, WeightRoles
from coppice.queries.base import query, r, rounded, table
from coppice.queries.features import PLACES_SQL, code_sql, decay_sql, places_of, season_sql, zscore_sql
from coppice.queries.profiles import DOCS, labelled

JOINED = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


def order_rows(spark, sf):
    """Orders with their customer; both sides keep only what is used."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return conform_date(joined, "o_orderdate")


@query(
    "feature_matrix",
    f"""SELECT o_orderkey, c_acctbal, cs.code AS ordinal_c_mktsegment, cp.code AS ordinal_o_orderpriority,
               {season_sql("o_orderdate")}
        FROM {JOINED} o JOIN {code_sql("customer", "c_mktsegment")} cs ON c_mktsegment = cs.level
        JOIN {code_sql("orders", "o_orderpriority")} cp ON o_orderpriority = cp.level""",
)
def feature_matrix(spark, sf):
    df = order_rows(spark, sf)
    roles = FeatureRoles(("c_mktsegment", "o_orderpriority"), ("c_acctbal",), date="o_orderdate")
    fitted = assemble.feature_steps(roles).fit(df)
    out = fitted.transform(df)
    return out.select(
        "o_orderkey",
        *(rounded(c).alias(c) if c.startswith("season") else F.col(c) for c in fitted.output_columns),
    )


@query(
    "feature_matrix_places",
    f"""SELECT s_suppkey, s_acctbal, {PLACES_SQL} FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def feature_matrix_places(spark, sf):
    nation = F.col("s_nationkey").cast("double")
    df = table(spark, sf, "supplier").select(
        "s_suppkey", "s_acctbal", (nation * 3 - 36).alias("lat"), (nation * 7 - 84).alias("lon")
    )
    roles = FeatureRoles((), ("s_acctbal",), latitude="lat", longitude="lon")
    fitted = assemble.feature_steps(roles, places_of(spark, sf)).fit(df)
    return fitted.transform(df).select("s_suppkey", *fitted.output_columns)


@query(
    "numeric_target",
    f"""SELECT o_orderkey, {r(zscore_sql("y", "o_orderpriority"))} AS label
        FROM (SELECT *, ln(1 + o_totalprice) AS y FROM orders)""",
)
def numeric_target(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    fitted = assemble.target_steps(TargetRole("o_totalprice", log=True, scale_by_category="o_orderpriority")).fit(df)
    return fitted.transform(df).select("o_orderkey", rounded(fitted.output_columns[-1]).alias("label"))


@query(
    "numeric_target_ratio",
    f"""SELECT l_orderkey, l_linenumber, {r("ln(1 + l_extendedprice) / l_quantity")} AS label FROM lineitem""",
)
def numeric_target_ratio(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    fitted = assemble.target_steps(TargetRole("l_extendedprice", log=True, scale_by_number="l_quantity")).fit(df)
    label = rounded(fitted.output_columns[-1]).alias("label")
    return fitted.transform(df).select("l_orderkey", "l_linenumber", label)


@query(
    "class_target",
    f"""SELECT doc_id, code AS label, (SELECT count(*) FROM {code_sql(DOCS, "grade")}) AS num_classes
        FROM {DOCS} d JOIN {code_sql(DOCS, "grade")} c ON d.grade IS NOT DISTINCT FROM c.level""",
)
def class_target(spark, sf):
    df = labelled(spark, sf)
    fitted = assemble.target_steps(TargetRole("grade", is_categorical=True)).fit(df)
    n = F.lit(fitted.steps[-1].num_classes).cast("bigint")
    return fitted.transform(df).select("doc_id", F.col(fitted.output_columns[-1]).alias("label"), n.alias("num_classes"))


@query(
    "sample_weight",
    f"""SELECT o_orderkey, {r('''1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderdate::DATE)
               + ''' + decay_sql("orders", "o_orderdate", 0.1) + '''
               + 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderpriority)
               + 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus)''', 9)} AS weight FROM orders""",
)
def sample_weight(spark, sf):
    df = conform_date(table(spark, sf, "orders"), "o_orderdate")
    roles = WeightRoles(date="o_orderdate", groups=("o_orderpriority", "o_orderstatus"))
    fitted = assemble.weight_steps(roles).fit(df)
    weight = F.col(f"`{fitted.output_columns[-1]}`")
    return fitted.transform(df).select("o_orderkey", rounded(weight, 9).alias("weight"))


@query("sample_weight_default", "SELECT o_orderkey, 1.0::DOUBLE AS weight FROM orders")
def sample_weight_default(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    fitted = assemble.weight_steps(WeightRoles()).fit(df)
    return fitted.transform(df).select("o_orderkey", F.col(fitted.output_columns[-1]).alias("weight"))


@query(
    "steps_roundtrip",
    f"""SELECT l_orderkey, l_linenumber, {r("l_extendedprice", 4)} AS l_extendedprice FROM lineitem""",
)
def steps_roundtrip(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    log = scale.Log("l_extendedprice")
    chain = steps.Chain((log, scale.ZScore(log.output_columns[0], "l_returnflag")))
    fitted = chain.fit(df)
    label = fitted.output_columns[-1]
    labels = fitted.transform(df).select("l_orderkey", "l_linenumber", "l_returnflag", label)
    back = fitted.inverse(labels)
    return back.select("l_orderkey", "l_linenumber", rounded("l_extendedprice", 4).alias("l_extendedprice"))


CONTRACT_ROLES = ModelRoles(
    FeatureRoles(("lang", "grade"), ("n_chars", "toxic"), date="day"),
    TargetRole("quality"),
    WeightRoles(date="day", groups=("source", "missing")),
)
DAY_SQL = "CASE WHEN lang = 'fr' THEN 'no date' WHEN lang = 'de' THEN NULL ELSE '2024-01-' || (10 + doc_id % 20) END"


def _contract_sql() -> str:
    rows = []
    for column, role, kind in contract.needs_of(CONTRACT_ROLES, prediction=False):
        if column == "missing":
            rows.append(f"SELECT '{column}', '{role}', false, false, NULL::BIGINT, NULL::BIGINT")
            continue
        bad = "NULL::BIGINT"
        if kind == "date":
            bad = f"count(*) FILTER (TRY_CAST({column} AS TIMESTAMP) IS NULL AND {column} IS NOT NULL)"
        rows.append(f"SELECT '{column}', '{role}', true, true, count(*) FILTER ({column} IS NULL), {bad} FROM t")
    body = " UNION ALL ".join(rows)
    return f"""WITH t AS (SELECT *, {DAY_SQL} AS day FROM {DOCS})
               SELECT * FROM ({body}) AS c("column", role, present, type_ok, nulls, unreadable_dates)"""


@query("input_contract", _contract_sql())
def input_contract(spark, sf):
    day = (
        F.when(F.col("lang") == "fr", "no date")
        .when(F.col("lang") != "de", F.concat(F.lit("2024-01-"), (F.col("doc_id") % 20 + 10).cast("string")))
    )
    df = labelled(spark, sf).withColumn("day", day)
    return contract.input_contract(df, contract.needs_of(CONTRACT_ROLES, prediction=False))


# A registry made from the events: one model per user, calls are the user's purchases.
MODELS_SQL = """(SELECT 'M' || user_id AS model_key, min(ts) AS created_at,
                        CASE user_id % 3 WHEN 0 THEN 'value' ELSE 'event_type' END AS target,
                        user_id % 3 <> 0 AS target_is_categorical, CASE WHEN user_id % 2 = 0 THEN 'ts' END AS date
                 FROM events GROUP BY user_id)"""


def model_rows(spark, sf):
    user = F.col("user_id")
    nothing = F.lit(None).cast("string")
    return (
        table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.min("ts").cast("timestamp").alias("created_at"))
        .select(
            F.concat(F.lit("M"), user.cast("string")).alias("model_key"),
            "created_at",
            F.when(user % 3 == 0, "value").otherwise("event_type").alias("target"),
            (user % 3 != 0).alias("target_is_categorical"),
            F.when(user % 2 == 0, "ts").alias("date"),
            nothing.alias("latitude"),
            nothing.alias("longitude"),
            F.array().cast("array<string>").alias("groups"),
            F.array(F.lit("value")).alias("features"),
            F.lit(100).cast("bigint").alias("call_limit"),
        )
    )


def call_rows(spark, sf):
    return (
        table(spark, sf, "events")
        .filter("event_type = 'purchase'")
        .select(F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("model_key"), F.col("ts").alias("called_at"))
    )


@query(
    "same_problem_models",
    f"""SELECT target, target_is_categorical, date, count(*) AS n_models, min(model_key) AS first_key,
               epoch_us(max(created_at)) AS newest_us FROM {MODELS_SQL} GROUP BY ALL""",
)
def models_of_a_problem(spark, sf):
    df = same_problem_models(model_rows(spark, sf))
    return df.withColumn("newest_us", F.unix_micros("newest")).drop("newest", "latitude", "longitude", "groups")
