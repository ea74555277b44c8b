"""Tables from and to files."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from coppice.functions.schema import quote

# Quotes are doubled, text may hold line breaks, and an empty text differs from null.
CSV_TEXT = {"quote": '"', "escape": '"', "emptyValue": '""', "nullValue": ""}
# An empty text is read as this mark first, or the reader would take it for null.
EMPTY = "\x00empty"
CSV_READ = {**CSV_TEXT, "emptyValue": EMPTY, "header": True, "multiLine": True}
# Suffix -> format and options.
READERS = {
    ".csv": ("csv", {**CSV_READ, "inferSchema": True}),
    ".parquet": ("parquet", {}),
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Without a schema the file is read once more to infer one.

    Text may hold quotes and line breaks. A file is therefore read by one task;
    large tables need many files, or ``multiLine=False`` for text without line
    breaks. Further ``options`` are those of Spark's reader, ``sep`` say.
    """
    reader = spark.read.options(**{**CSV_READ, **options})
    if schema is not None:
        return _empties(reader.schema(schema).csv(path))
    return _empties(reader.option("inferSchema", True).csv(path))


def _empties(df: DataFrame) -> DataFrame:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select(*(
        F.when(F.col(quote(c)) == EMPTY, "").otherwise(F.col(quote(c))).alias(c) if c in texts else F.col(quote(c))
        for c in df.columns
    ))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, **more) -> DataFrame:
    """Choose the reader by suffix; an unknown suffix is a ``ValueError``. ``more`` are options of the reader."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"cannot tell the format of {path}")
    name, options = READERS[suffix]
    reader = spark.read.format(name)
    if schema is not None:
        reader, options = reader.schema(schema), {k: v for k, v in options.items() if k != "inferSchema"}
    df = reader.options(**{**options, **more}).load(path)
    return _empties(df) if name == "csv" else df


def ingest(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: StructType | str | None = None, **options
) -> tuple[DataFrame, int]:
    """Load, keep in memory and on disk, and count.

    Name the ``columns`` needed: a persisted table cannot be pruned later. The
    files must stay where they are, lost blocks are read again. Call
    ``unpersist`` when done.
    """
    df = load(spark, path, schema, **options)
    df = (df.select(*columns) if columns else df).persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def write_csv(df: DataFrame, path: str) -> None:
    """One file per partition, each with a header, quotes doubled. Also the export of predictions."""
    df.write.options(**CSV_TEXT, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def preview(df: DataFrame, order: Sequence[Column | str], n: int = 100) -> DataFrame:
    """The first n rows in an order, a top-n and no full sort; count rows with ``df.count()``."""
    return df.orderBy(*order).limit(n)


def rows_from_lists(spark: SparkSession, lists: Mapping[str, list]) -> DataFrame:
    """A table from a Python dict of equally long lists."""
    lengths = {len(v) for v in lists.values()}
    if len(lengths) > 1:
        raise ValueError(f"lists differ in length: { {k: len(v) for k, v in lists.items()} }")
    return spark.createDataFrame(pa.table({k: list(v) for k, v in lists.items()}))


def rows_from_arrays(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row per position of equally long array columns; other columns are repeated."""
    first, *others = arrays
    equal = F.lit(True)
    for other in others:
        equal = equal & F.size(first).eqNullSafe(F.size(other))
    checked = F.when(equal, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays differ in length")))
    kept = [c for c in df.columns if c not in arrays]
    return df.select(*kept, F.inline(checked))
