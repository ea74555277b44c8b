"""Scalar expressions and feature steps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.operators import dates, encode, nearest, place, scale, steps, weight
from coppice.queries.base import query, r, rounded, table
from coppice.queries.profiles import DOCS, labelled


@query("constant_column", "SELECT l_orderkey, l_linenumber, 1 AS constant_1 FROM lineitem")
def constant_column(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return steps.Constant(1).transform(df)


@query("select_passthrough", "SELECT l_quantity, l_discount FROM lineitem")
def select_passthrough(spark, sf):
    kept = steps.Keep(("l_quantity", "l_discount"))
    return kept.transform(table(spark, sf, "lineitem")).select(*kept.output_columns)


@query(
    "row_sum",
    f"""SELECT l_orderkey, l_linenumber, {r("l_quantity + l_discount + l_tax")} AS "sum_l_quantity+l_discount+l_tax"
        FROM lineitem""",
)
def row_sum(spark, sf):
    step = steps.RowSum(("l_quantity", "l_discount", "l_tax"))
    name = step.output_columns[0]
    df = step.transform(table(spark, sf, "lineitem"))
    return df.select("l_orderkey", "l_linenumber", rounded(F.col(f"`{name}`")).alias(name))


@query(
    "row_sum_nulls",
    f'SELECT doc_id, quality + toxic AS "sum_quality+toxic" FROM {DOCS}',
)
def row_sum_nulls(spark, sf):
    step = steps.RowSum(("quality", "toxic"))
    return step.transform(labelled(spark, sf)).select("doc_id", f"`{step.output_columns[0]}`")


@query("conform_date", "SELECT event_id, epoch_us(ts) AS us FROM events")
def conform_date(spark, sf):
    df = dates.conform_date(table(spark, sf, "events"), "ts")
    return df.select("event_id", F.unix_micros("ts").alias("us"))


@query(
    "conform_text_date",
    """SELECT o_orderkey, epoch_us(TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP)) AS us FROM orders""",
)
def conform_text_date(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = dates.conform_date(table(spark, sf, "orders").withColumn("day", text), "day")
    return df.select("o_orderkey", F.unix_micros("day").alias("us"))


@query(
    "truncate_day",
    "SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') AS day FROM events",
)
def truncate_day(spark, sf):
    df = dates.conform_date(table(spark, sf, "events"), "ts")
    return df.select("event_id", X.day_of("ts").cast("string").alias("day"))


PART_SQL = {
    "day_of_week": "isodow({d}) - 1",
    "day_of_month": "day({d})",
    "week_of_year": "week({d})",
    "day_of_year": "dayofyear({d}) - 1",
}


@query(
    "calendar_parts",
    "SELECT o_orderkey, "
    + ", ".join(f"({sql.format(d='o_orderdate')})::INT AS {part}" for part, sql in PART_SQL.items())
    + " FROM orders",
)
def calendar_parts(spark, sf):
    df = dates.conform_date(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return dates.calendar_parts(df, "o_orderdate").drop("o_orderdate")


def season_sql(date: str) -> str:
    terms = []
    for part, sql in PART_SQL.items():
        period = X.SEASON_PARTS[part][0]
        for phase in X.season_phases(part):
            for kind in ("sin", "cos"):
                angle = f"{2 * math.pi!r}::DOUBLE * (({sql.format(d=date)}) + {phase}) / {period}::DOUBLE"
                terms.append(f"{r(f'{kind}({angle})')} AS season_{part}_{kind}_{phase}")
    return ", ".join(terms)


@query("seasonality", f"SELECT event_id, {season_sql('ts')} FROM events")
def seasonality(spark, sf):
    df = dates.conform_date(table(spark, sf, "events").select("event_id", "ts"), "ts")
    season = dates.Season("ts")
    return season.transform(df).select("event_id", *(rounded(c).alias(c) for c in season.output_columns))


DAY_US = X.MICROS_PER_DAY


def decay_sql(source: str, date: str, rate: float) -> str:
    newest = f"(SELECT max(epoch_us({date})) FROM {source})"
    return f"exp(-{rate}::DOUBLE * (({newest} - epoch_us({date})) // {DAY_US}) / {X.YEAR_DAYS}::DOUBLE)"


@query("decay_weight", f"SELECT event_id, {r(decay_sql('events', 'ts', 0.1), 9)} AS decay_ts FROM events")
def decay_weight(spark, sf):
    df = dates.conform_date(table(spark, sf, "events").select("event_id", "ts"), "ts")
    return weight.Decay("ts", 0.1).fit(df).transform(df).select("event_id", rounded("decay_ts", 9).alias("decay_ts"))


@query(
    "day_weight",
    f"""SELECT event_id, {r("1.0::DOUBLE / count(*) OVER (PARTITION BY ts::DATE)", 9)} AS balance_ts FROM events""",
)
def day_weight(spark, sf):
    df = dates.conform_date(table(spark, sf, "events").select("event_id", "ts"), "ts")
    fitted = weight.Balance("ts").fit(df)
    return fitted.transform(df).select("event_id", rounded("balance_ts", 9).alias("balance_ts"))


@query(
    "group_weight",
    f"""SELECT doc_id, CASE WHEN grade IS NOT NULL
               THEN {r("1.0::DOUBLE / count(*) OVER (PARTITION BY grade)", 9)} END AS balance_grade FROM {DOCS}""",
)
def group_weight(spark, sf):
    df = labelled(spark, sf).select("doc_id", "grade")
    fitted = weight.Balance("grade").fit(df)
    return fitted.transform(df).select("doc_id", rounded("balance_grade", 9).alias("balance_grade"))


@query("log_target", f"SELECT o_orderkey, {r('ln(1 + o_totalprice)')} AS log1p_o_totalprice FROM orders")
def log_target(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    fitted = scale.Log("o_totalprice").fit(df)
    return fitted.transform(df).select("o_orderkey", rounded("log1p_o_totalprice").alias("log1p_o_totalprice"))


@query("log_roundtrip", f"SELECT o_orderkey, {r('o_totalprice', 4)} AS o_totalprice FROM orders")
def log_roundtrip(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    fitted = scale.Log("o_totalprice").fit(df)
    back = fitted.inverse(fitted.transform(df).drop("o_totalprice"))
    return back.select("o_orderkey", rounded("o_totalprice", 4).alias("o_totalprice"))


# A divisor that is null, zero or the discount.
BASE_SQL = "(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END)"


def with_base(spark, sf):
    base = F.when(F.col("l_linenumber") != 1, F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", base.alias("base"))


@query(
    "ratio_scale",
    f"""SELECT l_orderkey, l_linenumber,
               {r(f"l_quantity / nullif(coalesce({BASE_SQL}, 1.0), 0.0)")} AS ratio_l_quantity_by_base FROM lineitem""",
)
def ratio_scale(spark, sf):
    df = scale.Ratio("l_quantity", "base").transform(with_base(spark, sf))
    name = "ratio_l_quantity_by_base"
    return df.select("l_orderkey", "l_linenumber", rounded(name).alias(name))


@query(
    "ratio_inverse",
    f"""SELECT l_orderkey, l_linenumber,
               {r(f"CASE WHEN coalesce({BASE_SQL}, 1.0) <> 0 THEN l_quantity END")} AS l_quantity FROM lineitem""",
)
def ratio_inverse(spark, sf):
    step = scale.Ratio("l_quantity", "base")
    df = step.inverse(step.transform(with_base(spark, sf)).drop("l_quantity"))
    return df.select("l_orderkey", "l_linenumber", rounded("l_quantity").alias("l_quantity"))


@query(
    "clean_names",
    r"""SELECT p_partkey, regexp_replace(p_name, '[^\p{L}\p{N}]', '_', 'g') AS name,
               regexp_replace(p_brand, '[^\p{L}\p{N}]', '_', 'g') AS brand FROM part""",
)
def clean_names(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", X.tag_text("p_name").alias("name"), X.tag_text("p_brand").alias("brand"))


LATLON_SQL = "(c_nationkey * 9.5 - 100)::DOUBLE AS lat, (c_nationkey * 16.25 - 190)::DOUBLE AS lon"


def located(spark, sf):
    nation = F.col("c_nationkey").cast("double")
    return table(spark, sf, "customer").select(
        "c_custkey", (nation * 9.5 - 100).alias("lat"), (nation * 16.25 - 190).alias("lon")
    )


@query(
    "latlon_valid",
    f"""SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid_place
        FROM (SELECT c_custkey, {LATLON_SQL} FROM customer)""",
)
def latlon_valid(spark, sf):
    return place.latlon_flags(located(spark, sf), "lat", "lon")


def code_sql(source: str, column: str) -> str:
    """Level and code, null first."""
    return f"""(SELECT {column} AS level, row_number() OVER (ORDER BY {column} NULLS FIRST) - 1 AS code
                FROM (SELECT DISTINCT {column} FROM {source}))"""


@query(
    "ordinal_encode",
    f"""SELECT doc_id, grade, code AS ordinal_grade FROM {DOCS} d
        JOIN {code_sql(DOCS, "grade")} c ON d.grade IS NOT DISTINCT FROM c.level""",
)
def ordinal_encode(spark, sf):
    df = labelled(spark, sf).select("doc_id", "grade")
    return encode.Ordinal("grade").fit(df).transform(df)


@query(
    "ordinal_encode_text",
    f"""SELECT doc_id, code AS ordinal_text FROM documents
        JOIN {code_sql("documents", "text")} c ON text = level""",
)
def ordinal_encode_text(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return encode.Ordinal("text").fit(df).transform(df).select("doc_id", "ordinal_text")


@query(
    "ordinal_append",
    f"""WITH first AS (SELECT * FROM {DOCS} WHERE quality = 1 AND toxic = 0),
             known AS {code_sql("first", "source")},
             added AS (SELECT level, code + (SELECT count(*) FROM known) AS code FROM
                       {code_sql(f"(SELECT source FROM {DOCS} WHERE source NOT IN (SELECT level FROM known))", "source")})
        SELECT doc_id, source, code AS ordinal_source FROM {DOCS} d
        JOIN (FROM known UNION ALL FROM added) c ON d.source = c.level""",
)
def ordinal_append(spark, sf):
    df = labelled(spark, sf)
    first = encode.Ordinal("source").fit(df.filter("quality = 1 and toxic = 0"))
    return first.extend(df).transform(df.select("doc_id", "source"))


@query(
    "ordinal_unseen",
    f"""SELECT o_orderkey, c.code AS ordinal_o_orderpriority FROM orders
        LEFT JOIN {code_sql("(SELECT * FROM orders WHERE o_orderpriority <> '3-MEDIUM')", "o_orderpriority")} c
        ON o_orderpriority = c.level""",
)
def ordinal_unseen(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    fitted = encode.Ordinal("o_orderpriority").fit(df.filter("o_orderpriority <> '3-MEDIUM'"))
    return fitted.transform(df).drop("o_orderpriority")


@query("ordinal_decode", f"SELECT doc_id, grade FROM {DOCS}")
def ordinal_decode(spark, sf):
    df = labelled(spark, sf).select("doc_id", "grade")
    fitted = encode.Ordinal("grade").fit(df)
    return fitted.inverse(fitted.transform(df).drop("grade")).select("doc_id", "grade")


@query(
    "one_hot",
    f"""SELECT doc_id, coalesce(grade = 'bad', false)::INT AS onehot_grade_is_bad,
               coalesce(grade = 'good', false)::INT AS onehot_grade_is_good FROM {DOCS}""",
)
def one_hot(spark, sf):
    df = labelled(spark, sf).select("doc_id", "grade")
    return encode.OneHot("grade").fit(df).transform(df).drop("grade")


@query("one_hot_decode", "SELECT o_orderkey, o_orderpriority FROM orders")
def one_hot_decode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    fitted = encode.OneHot("o_orderpriority").fit(df)
    return fitted.inverse(fitted.transform(df).drop("o_orderpriority")).select("o_orderkey", "o_orderpriority")


@query("one_hot_decode_wide", "SELECT c_custkey, c_name FROM customer")
def one_hot_decode_wide(spark, sf):
    """As many levels as rows."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    fitted = encode.OneHotVector("c_name").fit(df)
    return fitted.inverse(fitted.transform(df).drop("c_name")).select("c_custkey", "c_name")


@query("one_hot_decode_nulls", f"SELECT doc_id, grade FROM {DOCS}")
def one_hot_decode_nulls(spark, sf):
    df = labelled(spark, sf).select("doc_id", "grade")
    fitted = encode.OneHot("grade", on_invalid="null").fit(df)
    return fitted.inverse(fitted.transform(df).drop("grade")).select("doc_id", "grade")


@query(
    "zscore",
    f"""SELECT o_orderkey, {r('''(o_totalprice - (SELECT avg(o_totalprice) FROM orders))
               / (SELECT stddev_samp(o_totalprice) FROM orders)''')} AS zscore_o_totalprice FROM orders""",
)
def zscore(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = scale.ZScore("o_totalprice").fit(df).transform(df)
    return out.select("o_orderkey", rounded("zscore_o_totalprice").alias("zscore_o_totalprice"))


def zscore_sql(column: str, group: str) -> str:
    w = f"OVER (PARTITION BY {group})"
    return f"({column} - avg({column}) {w}) / coalesce(nullif(stddev_samp({column}) {w}, 0), 1.0)"


@query(
    "zscore_by_group",
    f"""SELECT o_orderkey, {r(zscore_sql("o_totalprice", "o_orderpriority"))} AS z FROM orders""",
)
def zscore_by_group(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    step = scale.ZScore("o_totalprice", "o_orderpriority")
    return step.fit(df).transform(df).select("o_orderkey", rounded(step.output_columns[0]).alias("z"))


@query(
    "zscore_by_text",
    f"""SELECT doc_id, {r(zscore_sql("n_chars", "text"))} AS z FROM documents""",
)
def zscore_by_text(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    step = scale.ZScore("n_chars", "text")
    return step.fit(df).transform(df).select("doc_id", rounded(step.output_columns[0]).alias("z"))


@query("zscore_inverse", f"SELECT o_orderkey, {r('o_totalprice', 4)} AS o_totalprice FROM orders")
def zscore_inverse(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    fitted = scale.ZScore("o_totalprice", "o_orderpriority").fit(df)
    back = fitted.inverse(fitted.transform(df).drop("o_totalprice"))
    return back.select("o_orderkey", rounded("o_totalprice", 4).alias("o_totalprice"))


def places_of(spark, sf):
    """A table of places made from the nations; one region has no entries."""
    nation = F.col("n_nationkey").cast("double")
    values = {
        name: (nation * (i + 1) + F.length("n_name")).alias(name) for i, name in enumerate(place.place_columns())
    }
    return (
        table(spark, sf, "nation")
        .filter("n_regionkey <> 4")
        .select((nation * 3 - 36).alias("latitude"), (nation * 7 - 84).alias("longitude"), *values.values())
    )


PLACES_SQL = ", ".join(
    f"(CASE WHEN n_regionkey <> 4 THEN n_nationkey * {i + 1} + length(n_name) END)::DOUBLE AS {name}"
    for i, name in enumerate(place.place_columns())
)


@query(
    "location_features",
    f"SELECT s_suppkey, {PLACES_SQL} FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def location_features(spark, sf):
    nation = F.col("s_nationkey").cast("double")
    df = table(spark, sf, "supplier").select(
        "s_suppkey", (nation * 3 - 36).alias("lat"), (nation * 7 - 84).alias("lon")
    )
    fitted = place.PlaceFeatures("lat", "lon", places_of(spark, sf), on_missing="null").fit(df)
    return fitted.transform(df).drop("lat", "lon")


def spread_sql(key: str) -> str:
    """Places all over the globe, some of them null."""
    return (f"CASE WHEN {key} % 11 <> 3 THEN (({key} * 7919) % 17000) / 100.0::DOUBLE - 85 END AS latitude, "
            f"(({key} * 104729) % 36000) / 100.0::DOUBLE - 180 AS longitude")


def spread(df, key: str):
    k = F.col(key).cast("bigint")
    return df.select(
        key,
        F.when(k % 11 != 3, (k * 7919) % 17000 / F.lit(100.0) - 85).alias("latitude"),
        ((k * 104729) % 36000 / F.lit(100.0) - 180).alias("longitude"),
    )


REACH_KM = 800


def on_sphere_sql(source: str, key: str) -> str:
    return f"""(SELECT {key}, cos(radians(latitude)) * cos(radians(longitude)) AS x,
                       cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z
                FROM (SELECT {key}, {spread_sql(key)} FROM {source}) WHERE latitude IS NOT NULL)"""


@query(
    "nearest_place",
    f"""WITH pairs AS (SELECT c_custkey, s_suppkey, floor(asin(least(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)
                              + (c.z - s.z) * (c.z - s.z)) / 2, 1.0)) * {2000 * nearest.EARTH_M!r}::DOUBLE + 0.5) AS mm
                       FROM {on_sphere_sql("customer", "c_custkey")} c, {on_sphere_sql("supplier", "s_suppkey")} s),
             best AS (SELECT c_custkey, arg_min(s_suppkey, (mm, s_suppkey)) AS s_suppkey, min(mm) AS mm FROM pairs
                      WHERE mm <= {REACH_KM * 10**6} GROUP BY c_custkey)
        SELECT customer.c_custkey, s_suppkey AS nearest_supplier, {r("mm / 1000", 3)} AS metres
        FROM customer LEFT JOIN best ON customer.c_custkey = best.c_custkey""",
)
def nearest_place(spark, sf):
    customers = spread(table(spark, sf, "customer"), "c_custkey")
    suppliers = spread(table(spark, sf, "supplier"), "s_suppkey")
    found = nearest.attach_nearest(
        customers, "latitude", "longitude", suppliers, REACH_KM * 1000.0, "s_suppkey", "nearest_supplier", "metres"
    )
    return found.select("c_custkey", "nearest_supplier", rounded("metres", 3).alias("metres"))
