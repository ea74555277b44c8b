"""Sources, sinks, previews and synthetic columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from coppice.operators import lookup, stats
from coppice.queries.base import big, query, r, rounded, table
from coppice.session import materialise, scratch_path
from coppice.sources import files, synth

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query("csv_roundtrip", f"SELECT {CUSTOMER} FROM customer")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "customer")
    files.write_csv(table(spark, sf, "customer"), path)
    df = files.read_csv(spark, path)
    return df.withColumns({"c_custkey": big("c_custkey"), "c_nationkey": F.col("c_nationkey").cast("int")})


@query("csv_roundtrip_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_text(spark, sf):
    """Texts with line breaks, quotes and separators survive."""
    path = scratch_path(spark, "documents")
    docs = table(spark, sf, "documents")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema)


@query("parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def parquet_scan(spark, sf):
    return files.read_parquet(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "load_by_extension",
    """SELECT format, p_partkey, p_name, p_retailprice
       FROM part CROSS JOIN (VALUES ('csv'), ('parquet')) AS f(format)""",
)
def load_by_extension(spark, sf):
    parquet = files.load(spark, f"{sf}/part.parquet")
    path = scratch_path(spark, "part") + ".csv"
    files.write_csv(parquet, path)
    csv = files.load(spark, path, parquet.schema)
    parts = [
        df.select(F.lit(kind).alias("format"), "p_partkey", "p_name", "p_retailprice")
        for kind, df in (("csv", csv), ("parquet", parquet))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "cached_ingest",
    f"""SELECT s_nationkey, count(*) AS n, {r("sum(s_acctbal)", 2)} AS balance,
               (SELECT count(*) FROM supplier) AS rows_loaded
        FROM supplier GROUP BY s_nationkey""",
)
def cached_ingest(spark, sf):
    df, rows = files.ingest(spark, f"{sf}/supplier.parquet", ["s_nationkey", "s_acctbal"])
    counted = df.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum("s_acctbal"), 2).alias("balance"),
        F.lit(rows).cast("bigint").alias("rows_loaded"),
    )
    counted = materialise(counted)
    df.unpersist()
    return counted


@query(
    "rows_from_arrays",
    """SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding)))::BIGINT AS position
       FROM embeddings""",
)
def rows_from_arrays(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("value"),
        F.sequence(F.lit(0), F.size("embedding") - 1).cast("array<bigint>").alias("position"),
    )
    return files.rows_from_arrays(df, ["value", "position"])


@query(
    "preview_top",
    "SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)",
)
def preview_top(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return files.preview(df, [F.col("o_totalprice").desc(), "o_orderkey"], 100)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return stats.row_count(table(spark, sf, "lineitem"))


# The draw of coppice.functions.columns.unit_hash and normal_hash in SQL.
def draw(label: str, *key: str) -> str:
    text = ", ".join(f"{k}::VARCHAR" for k in key)
    return f"(('0x' || substr(md5(concat_ws('|', '{label}', {text})), 1, 13))::BIGINT / {16**13}::DOUBLE)"


def normal(label: str, *key: str) -> str:
    angle = f"cos({2 * math.pi!r}::DOUBLE * {draw(label + '/a', *key)})"
    return f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {draw(label + '/r', *key)})) * {angle}"


def letter(label: str, *key: str) -> str:
    return f"substr('{''.join(synth.LETTERS)}', floor({draw(label, *key)} * 26)::INT + 1, 1)"


def iid_sql(seed: int, *key: str) -> str:
    letters = [f"{letter(f'{seed}/categorical_{i}', *key)} AS categorical_{i}" for i in range(2)]
    numbers = [f"{r(normal(f'{seed}/numeric_{i}', *key))} AS numeric_{i}" for i in range(2)]
    return ", ".join(letters + numbers)


def round_numbers(df):
    return df.withColumns({f"numeric_{i}": rounded(f"numeric_{i}") for i in range(2)})


@query("synth_iid", f"SELECT o_orderkey, {iid_sql(11, 'o_orderkey')} FROM orders")
def synth_iid(spark, sf):
    return round_numbers(synth.iid(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], seed=11))


@query(
    "synth_ts",
    f"""WITH days AS (SELECT DISTINCT date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS day FROM orders)
        SELECT strftime(DATE '2000-01-01' + day, '%Y-%m-%d') AS date, {iid_sql(12, 'day')} FROM days""",
)
def synth_ts(spark, sf):
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    days = table(spark, sf, "orders").select(day.alias("day")).distinct()
    df = round_numbers(synth.series(days, "day", seed=12)).drop("day")
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "synth_multi_ts",
    f"""SELECT s_name AS ts_type, strftime(DATE '2000-01-01' + day, '%Y-%m-%d') AS date, {iid_sql(13, 's_name', 'day')}
        FROM supplier CROSS JOIN (SELECT unnest(range(30))::INT AS day)""",
)
def synth_multi_ts(spark, sf):
    types = table(spark, sf, "supplier").select(F.col("s_name").alias("ts_type"))
    df = round_numbers(synth.multi_series(types, "ts_type", 30, seed=13))
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def place_case(field: int) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + (f"'{name}'" if field == 0 else f"{place[field - 1]}::DOUBLE")
        for i, (name, place) in enumerate(synth.PLACES.items())
    )
    return f"CASE floor({draw('14/place', 'c_custkey')} * 3)::INT {cases} END"


@query(
    "synth_spatial",
    f"""SELECT c_custkey, {iid_sql(14, 'c_custkey')}, {place_case(0)} AS location_name,
               {place_case(1)} AS lat, {place_case(2)} AS lon FROM customer""",
)
def synth_spatial(spark, sf):
    ids = table(spark, sf, "customer").select("c_custkey")
    return round_numbers(synth.spatial(ids, ["c_custkey"], seed=14))


@query(
    "sample_capped",
    f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        WHERE {draw('sample/7', 'l_orderkey', 'l_linenumber')} < 20000 / (SELECT count(*) FROM lineitem)::DOUBLE""",
)
def sample_capped(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lookup.sample_to_cap(df, 20_000, ["l_orderkey", "l_linenumber"])


@query(
    "sample_exact",
    f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        ORDER BY {draw('sample/7', 'l_orderkey', 'l_linenumber')} LIMIT 20000""",
)
def sample_exact(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lookup.sample_exactly(df, 20_000, ["l_orderkey", "l_linenumber"])
