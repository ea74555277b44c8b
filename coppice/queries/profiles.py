"""Joins, aggregates, profiles and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import encode, lookup, scale, stats, weight
from coppice.operators.dates import conform_date
from coppice.plans.roles import Roles, column_roles, target_choice
from coppice.queries.base import query, r, rounded, table


@query(
    "filter_by_dict",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'""",
)
def filter_by_dict(spark, sf):
    df = lookup.filter_by_dict(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})
    return df.select("o_orderkey", "o_orderstatus", "o_orderpriority")


DOCS = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
                  CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS grade
           FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled(spark, sf):
    """Documents with their labels, null where there is none, and the quality as text."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    grade = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("grade", grade)


@query(
    "filter_null_group",
    f"SELECT doc_id, lang FROM {DOCS} WHERE grade IS NULL AND lang = 'en'",
)
def filter_null_group(spark, sf):
    return lookup.filter_by_dict(labelled(spark, sf), {"grade": None, "lang": "en"}).select("doc_id", "lang")


@query(
    "fill_null_zero",
    f"SELECT doc_id, grade, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {DOCS}",
)
def fill_null_zero(spark, sf):
    return stats.fill_null_zero(labelled(spark, sf).select("doc_id", "grade", "quality", "toxic"))


@query(
    "enrich_by_key",
    f"""SELECT o_orderkey, {r("exp(sin(o_custkey::DOUBLE)) * (o_custkey % 7)")} AS keyed FROM orders""",
)
def enrich_by_key(spark, sf):
    key = F.col("o_custkey")
    df = lookup.enrich_by_key(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
        "o_custkey",
        lambda keys: keys.withColumn("keyed", F.exp(F.sin(key.cast("double"))) * (key % 7)),
    )
    return df.select("o_orderkey", rounded("keyed").alias("keyed"))


@query(
    "join_group_counts",
    """SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem""",
)
def join_group_counts(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return lookup.join_group_counts(df, "l_orderkey", "n")


@query(
    "dictionary_lookup",
    "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def dictionary_lookup(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return lookup.dictionary_lookup(df, "c_nationkey", nations, "nation").select("c_custkey", "nation")


@query(
    "dictionary_lookup_large",
    """SELECT l_orderkey, l_linenumber, o_orderpriority AS priority
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def dictionary_lookup_large(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    found = lookup.dictionary_lookup(df, "l_orderkey", orders, "priority")
    return found.select("l_orderkey", "l_linenumber", "priority")


@query(
    "positional_join",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
            b AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders)
       SELECT o_orderkey, o_totalprice AS value FROM a JOIN b USING (i)""",
)
def positional_join(spark, sf):
    orders = table(spark, sf, "orders")
    values = orders.select(
        (-F.col("o_totalprice")).alias("falling"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value")
    )
    return lookup.positional_join(orders.select("o_orderkey"), values, ["o_orderkey"], ["falling", "k"], "value")


@query("min_value", "SELECT min(c_acctbal) AS min FROM customer")
def min_value(spark, sf):
    return stats.min_value(table(spark, sf, "customer"), "c_acctbal")


@query("newest_date", "SELECT epoch_us(max(ts)) AS newest_us FROM events")
def newest_date(spark, sf):
    df = weight.newest_date(conform_date(table(spark, sf, "events"), "ts"), "ts")
    return df.select(F.unix_micros("newest").alias("newest_us"))


@query("negative_count", "SELECT count(*) FILTER (c_acctbal < 0) AS negatives FROM customer")
def negative_count(spark, sf):
    return scale.negative_count(table(spark, sf, "customer"), "c_acctbal")


@query(
    "mean_std_overall",
    f"""SELECT 'all' AS "group", {r("avg(o_totalprice)", 4)} AS mean, {r("stddev_samp(o_totalprice)", 4)} AS stddev
        FROM orders""",
)
def mean_std_overall(spark, sf):
    df = scale.mean_std(table(spark, sf, "orders"), "o_totalprice")
    return df.select("group", rounded("mean", 4).alias("mean"), rounded("stddev", 4).alias("stddev"))


@query(
    "mean_std_by_group",
    f"""SELECT o_orderpriority AS "group", {r("avg(o_totalprice)", 4)} AS mean,
               {r("coalesce(stddev_samp(o_totalprice), 1.0)", 4)} AS stddev
        FROM orders GROUP BY o_orderpriority""",
)
def mean_std_by_group(spark, sf):
    df = scale.mean_std(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return df.select("group", rounded("mean", 4).alias("mean"), rounded("stddev", 4).alias("stddev"))


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count(spark, sf):
    return weight.group_count(table(spark, sf, "events"), "event_type")


@query("distinct_levels", f"SELECT DISTINCT grade FROM {DOCS}")
def distinct_levels(spark, sf):
    return encode.distinct_levels(labelled(spark, sf), "grade")


@query("distinct_groups", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_groups(spark, sf):
    return stats.distinct_groups(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "num_classes",
    f"""SELECT 'grade' AS "column", count(DISTINCT grade) + max((grade IS NULL)::INT) AS num_classes FROM {DOCS}
        UNION ALL SELECT 'lang', count(DISTINCT lang) + max((lang IS NULL)::INT) FROM {DOCS}""",
)
def num_classes(spark, sf):
    return encode.num_classes(labelled(spark, sf), ["grade", "lang"])


def _profile_sql(source: str, numeric: list[str], text: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f"avg({c})", 4)} AS mean,
                   {r(f"stddev_samp({c})", 4)} AS stddev, min({c})::DOUBLE AS min_number,
                   max({c})::DOUBLE AS max_number, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text FROM {source}"""
        for c in numeric
    ] + [
        f"""SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, min({c}), max({c}) FROM {source}""" for c in text
    ]
    return " UNION ALL ".join(parts)


@query(
    "profile_table",
    _profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
)
def profile_table(spark, sf):
    df = stats.profile(table(spark, sf, "customer"))
    return df.withColumns({"mean": rounded("mean", 4), "stddev": rounded("stddev", 4)})


@query("profile_nulls", _profile_sql(DOCS, ["doc_id", "n_chars", "quality", "toxic"], ["lang", "source", "grade"]))
def profile_nulls(spark, sf):
    df = stats.profile(labelled(spark, sf))
    return df.withColumns({"mean": rounded("mean", 4), "stddev": rounded("stddev", 4)})


def thinned(spark, sf):
    """Orders with one column that is set in a single row and one that never is."""
    first = F.col("o_orderkey") == 0
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        "o_totalprice",
        "o_orderpriority",
        F.when(first, F.col("o_orderstatus")).alias("once"),
        F.when(first & ~first, F.col("o_custkey")).alias("never"),
    )


@query(
    "degenerate_columns",
    """SELECT * FROM (
         SELECT 'o_orderkey' AS "column", count(o_orderkey) AS count FROM orders
         UNION ALL SELECT 'once', count(*) FILTER (o_orderkey = 0) FROM orders
         UNION ALL SELECT 'never', count(*) FILTER (false) FROM orders) WHERE count <= 1""",
)
def degenerate_columns(spark, sf):
    return stats.degenerate_columns(thinned(spark, sf))


@query(
    "column_roles",
    """WITH alive AS (SELECT count(o_orderkey) > 1 AS o_orderkey, count(o_totalprice) > 1 AS o_totalprice,
                             count(o_orderpriority) > 1 AS o_orderpriority,
                             count(*) FILTER (o_orderkey = 0) > 1 AS once, false AS never FROM orders)
       SELECT 'o_orderkey' AS "column", unnest(['target', 'feature']) AS role FROM alive WHERE o_orderkey
       UNION ALL SELECT 'o_totalprice', 'target' FROM alive WHERE o_totalprice
       UNION ALL SELECT 'o_orderpriority', unnest(['target', 'feature']) FROM alive WHERE o_orderpriority
       UNION ALL SELECT 'once', unnest(['target', 'feature']) FROM alive WHERE once
       UNION ALL SELECT unnest(['o_orderpriority', 'once', 'o_orderdate']), 'date' FROM alive
       UNION ALL SELECT unnest(['o_orderkey', 'o_totalprice', 'never']), 'latitude' FROM alive
       UNION ALL SELECT unnest(['o_orderkey', 'o_totalprice', 'never']), 'longitude' FROM alive
       UNION ALL SELECT unnest(['o_orderpriority', 'once']), 'group' FROM alive""",
)
def roles_of_columns(spark, sf):
    return column_roles(thinned(spark, sf), target="o_totalprice", date="o_orderdate")


@query(
    "duplicate_rows",
    """SELECT text, lang, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1""",
)
def duplicate_rows(spark, sf):
    return stats.duplicate_rows(table(spark, sf, "documents"), ["text", "lang"])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
INDICATORS = {f"onehot_l_returnflag_is_{v}": f"(l_returnflag = '{v}')::INT::DOUBLE" for v in "ANR"}


def _corr_matrix_sql() -> str:
    entries = {c: c for c in NUMBERS} | INDICATORS
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f"corr({x}, {y})")} AS corr FROM lineitem"""
        for a, x in entries.items()
        for b, y in entries.items()
    )


@query("corr_matrix", _corr_matrix_sql())
def corr_matrix(spark, sf):
    df = stats.correlation_matrix(table(spark, sf, "lineitem"), [*NUMBERS, "l_returnflag"])
    return df.withColumn("corr", rounded("corr"))


@query(
    "level_correlation",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", level, '{y}' AS number,
                   {r(f"corr(({c} = level)::INT::DOUBLE, {y})")} AS corr
            FROM orders CROSS JOIN (SELECT DISTINCT {c} AS level FROM orders) GROUP BY level"""
        for c in ("o_orderstatus", "o_orderpriority")
        for y in ("o_totalprice", "o_custkey")
    ),
)
def level_correlation(spark, sf):
    df = stats.level_correlation(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"]
    )
    return df.withColumn("corr", rounded("corr"))


def _pair_sql(source: str, a: str, b: str, numeric: set[str]) -> str:
    """Brute force: correlate every indicator with every other and keep the strongest."""
    strongest = "arg_max(c, abs(c) * 2 + (c > 0)::INT * 1e-12)"
    if a in numeric and b in numeric:
        return f"(SELECT corr(coalesce({a}, 0)::DOUBLE, coalesce({b}, 0)::DOUBLE) FROM {source})"
    levels = {c: f"(SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL)" for c in (a, b) if c not in numeric}
    aliases = {c: f"v{i}" for i, c in enumerate(levels)}
    crossed = "".join(f" CROSS JOIN {q} AS {aliases[c]}" for c, q in levels.items())
    groups = ", ".join(f"{aliases[c]}.v" for c in levels)

    def value(c: str) -> str:
        if c in numeric:
            return f"coalesce({c}, 0)::DOUBLE"
        return f"coalesce({c} = {aliases[c]}.v, false)::INT::DOUBLE"

    return f"""(SELECT {strongest} FROM (SELECT corr({value(a)}, {value(b)}) AS c
                FROM {source}{crossed} GROUP BY {groups}) WHERE c IS NOT NULL AND NOT isnan(c))"""


def _collapsed_sql(source: str, columns: list[str], numeric: set[str]) -> str:
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            value = "1.0::DOUBLE" if i == j else _pair_sql(source, *((a, b) if i < j else (b, a)), numeric)
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(value)} AS corr")
    return " UNION ALL ".join(rows)


ORDER_COLUMNS = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("corr_collapsed", _collapsed_sql("orders", ORDER_COLUMNS, {"o_totalprice", "o_custkey"}))
def corr_collapsed(spark, sf):
    df = stats.collapsed_correlation(table(spark, sf, "orders"), ORDER_COLUMNS)
    return df.withColumn("corr", rounded("corr"))


DOC_COLUMNS = ["n_chars", "quality", "lang", "source", "grade"]


@query("corr_collapsed_nulls", _collapsed_sql(DOCS, DOC_COLUMNS, {"n_chars", "quality"}))
def corr_collapsed_nulls(spark, sf):
    df = stats.collapsed_correlation(labelled(spark, sf), DOC_COLUMNS)
    return df.withColumn("corr", rounded("corr"))


# Returned lines have a kind of their own: levels that never occur together.
LINES = """(SELECT *, CASE WHEN l_returnflag = 'R' THEN 'back' WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS kind
            FROM lineitem)"""


@query("corr_levels_apart", _collapsed_sql(LINES, ["l_returnflag", "kind", "l_linestatus"], set()))
def corr_levels_apart(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "back").when(F.col("l_quantity") > 25, "bulk").otherwise("single")
    df = table(spark, sf, "lineitem").withColumn("kind", kind)
    df = stats.collapsed_correlation(df, ["l_returnflag", "kind", "l_linestatus"])
    return df.withColumn("corr", rounded("corr"))


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query(
    "top_correlated",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(_pair_sql("lineitem", "l_extendedprice", c, set(NUMBERS)))} AS corr"""
        for c in LINE_FEATURES
    )
    + """) ORDER BY abs(corr) DESC, "column" LIMIT 1""",
)
def top_correlated(spark, sf):
    df = stats.top_correlated(table(spark, sf, "lineitem"), "l_extendedprice", LINE_FEATURES)
    return df.withColumn("corr", rounded("corr"))


def _choice_sql(source: str, target: str, features: list[str], numeric: set[str]) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {_pair_sql(source, target, c, numeric)} AS v, {c in numeric} AS is_number" for c in features
    )
    return f"""WITH best AS (SELECT * FROM ({pairs}) WHERE v IS NOT NULL AND NOT isnan(v) ORDER BY abs(v) DESC, c LIMIT 1),
                    strong AS (SELECT * FROM best WHERE abs(v) > 0.5)
               SELECT '{target}' AS "column", false AS is_categorical,
                      (SELECT min({target}) >= 0 FROM {source}) AS log,
                      (SELECT c FROM strong WHERE NOT is_number) AS scale_by_category,
                      (SELECT c FROM strong WHERE is_number) AS scale_by_number"""


@query("target_choice", _choice_sql("lineitem", "l_extendedprice", LINE_FEATURES, set(NUMBERS)))
def choice_by_number(spark, sf):
    roles = Roles(target="l_extendedprice", features=LINE_FEATURES)
    return target_choice(roles, table(spark, sf, "lineitem"))


BANDED = """(SELECT *, CASE WHEN o_totalprice < 250000 THEN 'low' ELSE 'high' END AS band,
                    o_totalprice - 1e6 AS shifted FROM orders)"""


@query(
    "target_choice_category",
    _choice_sql(BANDED, "shifted", ["o_custkey", "band", "o_orderstatus"], {"shifted", "o_custkey"}),
)
def choice_by_category(spark, sf):
    df = table(spark, sf, "orders").withColumns(
        {
            "band": F.when(F.col("o_totalprice") < 250000, "low").otherwise("high"),
            "shifted": F.col("o_totalprice") - 1e6,
        }
    )
    return target_choice(Roles(target="shifted", features=["o_custkey", "band", "o_orderstatus"]), df)
