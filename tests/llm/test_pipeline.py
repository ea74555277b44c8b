"""The pipeline's stages, each against a plain version on its own input."""

import os
import random
import sys

import pyarrow as pa
import pytest

import corpus_pipeline
from coppice.llm import decontaminate, jaccard_join
from coppice.session import TEXT_BATCHES, keep_batches_small

sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard_join import plain, texts  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(900_001, None, None, "s", 0), (900_002, "", "en", None, 0), (None, "12 34", "en", "s", 5)]
    docs = docs.unionByName(docs.limit(30)).unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    before = [tuple(r) for r in docs.collect()]
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and set(rows) <= set(before)
    assert not any(r[0] is None or r[0] > 900_000 for r in rows)
    assert len(rows) >= 0.97 * (len(before) - 3)

    single = corpus_pipeline.drop_near_duplicates(spark, kept, FOLDER)
    got = sorted((tuple(r) for r in single.collect()), key=repr)
    components, _ = plain([(r[0], r[1]) for r in rows], 80, 5)
    assert single.columns == docs.columns
    assert [r[0] for r in sorted(got)] == sorted({c for _, _, c in components})
    assert set(got) <= set(rows)

    clean = corpus_pipeline.decontaminate_benchmark(spark, single, FOLDER)
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = sorted((tuple(r) for r in clean.collect()), key=repr)
    assert left == [r for r in got if not any(i in decontaminate.normal(r[1]) for i in items)]
    packed = corpus_pipeline.pack_sequences(spark, clean, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in left}


@pytest.mark.parametrize("width, percent", [(5, 80), (4, 85)])
def test_keep_one(spark, width, percent):
    rows = list(enumerate(texts(7))) + [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row_mark int, cls string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.keep_one(docs, width=width, percent=percent).collect()), key=repr)
    # Ids in order of (id, nulls first); equal rows are one.
    keyed = [((-1 if i is None else i), t) for i, t in rows]
    components, _ = plain([(i * 1000 + n, t) for n, (i, t) in enumerate(keyed)], percent, width)
    want = [rows[c % 1000] for d, n, c in components if d == c]
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r[2:] == (1, "x") for r in got)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_texts_that_go_are_not_shuffled(spark):
    r = random.Random(1)
    long = " ".join(f"{r.getrandbits(64):x}" for _ in range(2000))
    other = " ".join(f"{r.getrandbits(64):x}" for _ in range(2000))
    rows = [(i, f"{long} {i}") for i in range(50)] + [(100, other), (100, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard_join.keep_one(docs)
        assert sorted(tuple(r) for r in kept.collect()) == [(0, f"{long} 0"), (100, other)]
        written, todo = 0, [kept._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            metric = node.metrics().get("shuffleBytesWritten")
            written += metric.get().value() if metric.isDefined() else 0
            below = node.children()
            todo += [below.apply(i) for i in range(below.size())]
            todo += [getattr(node, inner)() for inner in ("executedPlan", "plan") if inner in dir(node)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < written < 10 * len(long)


@pytest.fixture
def usual_batches(spark):
    """Spark's own limits of batches, whatever ran before."""
    for name in TEXT_BATCHES:
        spark.conf.unset(name)
    yield
    for name in TEXT_BATCHES:
        spark.conf.unset(name)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_few_texts_at_a_time(spark, usual_batches, tmp_path, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    path = str(tmp_path / "docs")
    spark.range(0, 9000, 1, 1).selectExpr("id doc_id", "repeat(sha2(string(id), 256), 50) text").write.parquet(path)
    docs = spark.read.parquet(path)
    stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20), FOLDER)
    texts_seen = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in texts_seen) == 9000 and max(r["size"] for r in texts_seen) < 4_000_000
    ids_seen = docs.select("doc_id").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in ids_seen) == 9000 and max(r["n"] for r in ids_seen) <= 2000  # their rows wait in the JVM meanwhile


def test_limits_of_the_user_stay(spark, usual_batches):
    for name in TEXT_BATCHES:
        spark.conf.set(name, "7")
    keep_batches_small(spark)
    assert {spark.conf.get(name) for name in TEXT_BATCHES} <= {"7", "7b"}
