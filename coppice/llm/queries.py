"""The registered queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import (
    cross_polytope,
    decontaminate,
    hard_negatives,
    html_density,
    jaccard_join,
    katz,
    language,
    license_sql,
    license_templates,
    packing,
    quotes,
    token_counts,
    warc,
    whitening,
)
from coppice.llm.textwork import find_package, id_hash_mod
from coppice.queries.base import Query, table

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            find_package(spark)
            return run(spark, folder)

        QUERIES[name] = Query(shipped, sql)
        return run

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_html_extraction")
def article_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_density.extract_articles(table(spark, folder, "pages"))


@query("op2_jaccard_join")
def near_duplicate_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


@query("op3_license_scan", license_sql.license_sql())
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_templates.scan_licenses(table(spark, folder, "documents"))


@query("op4_token_counts")
def greedy_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op5_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_decontamination")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_lm_scoring")
def language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = katz.fit(docs.where(id_hash_mod("doc_id", 10) != 0))
    scores = katz.score(docs, model)
    return scores.select("doc_id", F.coalesce(id_hash_mod("doc_id", 10) == 0, F.lit(True)).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


@query("op8_packing")
def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op9_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit_languages(docs.where(id_hash_mod("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.selectExpr("doc_id", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, true) as held_out", "lang_pred",
                            "score", "accepted")


@query("op10_quotation_linking")
def reply_ordered_chats(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.link_quotes(table(spark, folder, "conversations"))


@query("op11_whitening")
def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id,
       positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, ((k // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM p
"""


@query("op13_warc", WARC_SQL)
def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages"))
