"""Shared scratch space of a session and the two ways of cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of this session, taken from ``spark.checkpoint.dir``.

    A local master without that setting gets its own temporary folder; any
    other master without it is an error, because a folder on one machine is
    invisible to the other executors.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="coppice-")
        context.setCheckpointDir(configured)
    return (configured or context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/coppice-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store_columns(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and scan it from there.

    Unlike :func:`materialise` later readers can read a few columns only.
    """
    path = scratch_path(df.sparkSession, "columns")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark's default, and the largest method HotSpot compiles.
HUGE_METHOD, COMPILED_METHOD = "65535", "8000"


def keep_methods_compiled(spark: SparkSession) -> None:
    """Let stages with very many expressions fall back to split-up projections.

    HotSpot interprets methods above 8000 bytes of bytecode, and one stage of
    generated code with dozens of feature columns is far above that: leaving
    it whole costs several times the run time. A limit the user has set stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, HUGE_METHOD) == HUGE_METHOD:
        spark.conf.set(name, COMPILED_METHOD)


#: Rows and bytes of an Arrow batch, and rows that the Parquet reader decodes at a time, where rows hold whole texts.
#: Just under 4 MB, a batch is two slices of the 2 MB that the text operators take at once.
TEXT_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "3900000",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def keep_batches_small(spark: SparkSession) -> None:
    """Let stages that run one after the other in a session hold few whole texts at a time.

    At Spark's defaults a task holds 10,000 texts in the JVM (as rows that wait
    for their results, and in an Arrow buffer that doubles as it grows) and
    again in Python. An executor's JVM keeps what its heap has grown to, so
    stages add up. A limit the user has set stays.
    """
    for name, small in TEXT_BATCHES.items():
        if spark.conf.get(name, small) == small:
            spark.conf.set(name, small)
