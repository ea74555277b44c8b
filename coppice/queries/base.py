"""Registration of queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")
        REGISTERED[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded half up by plain arithmetic, which both engines do alike and fast."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / scale


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def r(expression: str, digits: int = 6) -> str:
    """SQL text of :func:`rounded`."""
    return f"(floor(({expression})::DOUBLE * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE)"
