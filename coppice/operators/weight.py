"""Row weights: recency and group balance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from coppice.functions import columns as X
from coppice.functions.schema import CATEGORICAL, TEMPORAL, quote, require
from coppice.operators.lookup import (
    WEIGHT,
    KeyedTable,
    attach,
    computed_once,
    count_keys,
    count_levels,
    freeze,
    local_frame,
    small_levels,
)
from coppice.operators.steps import Fitted, Found, Needs, Step


def newest_date(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(X.col(column)).alias("newest"))


@dataclass(frozen=True)
class FittedDecay(Fitted):
    column: str
    annual_rate: float
    newest: str
    year_days: float

    @property
    def output_columns(self) -> list[str]:
        return [f"decay_{self.column}"]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.column], TEMPORAL)
        newest = F.lit(self.newest).cast("timestamp")
        moment = X.col(self.column).cast("timestamp")
        return df.withColumn(self.output_columns[0], X.decay(moment, newest, self.annual_rate, self.year_days))


@dataclass(frozen=True)
class Decay(Step):
    """1 for the newest row, falling by ``exp(-annual_rate)`` per year before it."""

    column: str
    annual_rate: float = 0.1
    year_days: float = X.YEAR_DAYS

    def __post_init__(self):
        if not self.annual_rate >= 0:
            raise ValueError(f"annual rate {self.annual_rate} must not be negative")

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    @property
    def output_columns(self) -> list[str]:
        return [f"decay_{self.column}"]

    def needs(self, df: DataFrame) -> Needs:
        require(df, [self.column], TEMPORAL)
        return Needs(totals={f"newest {self.column}": (F.col(quote(self.column)).cast("timestamp"), lambda c: F.max(c).cast("string"))})

    def build(self, found: Found) -> FittedDecay:
        return FittedDecay(self.column, float(self.annual_rate), found.totals[f"newest {self.column}"], self.year_days)

    def fit(self, df: DataFrame) -> FittedDecay:
        require(df, [self.column], TEMPORAL)
        newest = newest_date(df.select(X.col(self.column).cast("timestamp").alias(self.column)), self.column)
        return FittedDecay(
            self.column, float(self.annual_rate), newest.select(F.col("newest").cast("string")).first()[0], self.year_days
        )


@dataclass(frozen=True)
class FittedBalance(Fitted):
    column: str
    by_day: bool
    table: KeyedTable

    @property
    def output_columns(self) -> list[str]:
        return [f"balance_{self.column}"]

    def transform(self, df: DataFrame) -> DataFrame:
        key = X.day_of(self.column) if self.by_day else X.col(self.column)
        return attach(df, self.table, {"key": key}, {"share": self.output_columns[0]})


@dataclass(frozen=True)
class Balance(Step):
    """One over the number of rows in the group, so that every group weighs 1 in total.

    Dates are grouped by day. Only the counts are shuffled, never the rows of
    a group. Null groups get a null weight.
    """

    column: str

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    @property
    def output_columns(self) -> list[str]:
        return [f"balance_{self.column}"]

    def fit(self, df: DataFrame) -> FittedBalance:
        return self.fit_many([self], df)[0]

    def _key(self, df: DataFrame) -> str:
        text = isinstance(df.schema[self.column].dataType, StringType)
        return self.column if text else f"day of {self.column}"

    def needs(self, df: DataFrame) -> Needs:
        require(df, [self.column], CATEGORICAL + TEMPORAL)
        key = self._key(df)
        return Needs(keys={key: F.col(quote(self.column)) if key == self.column else X.day_of(F.col(quote(self.column)))})

    def build(self, found: Found) -> FittedBalance:
        key = self._key(found.df)
        level = F.col("level") if key == self.column else F.col("level").cast("date")
        share = (F.lit(1.0) / F.col(WEIGHT)).alias("share")
        return FittedBalance(self.column, key != self.column,
                             freeze(found.levels(key).select(level.alias("key"), WEIGHT, share), ["key"]))

    @classmethod
    def fit_many(cls, steps: Sequence[Balance], df: DataFrame) -> list[FittedBalance]:
        require(df, [s.column for s in steps], CATEGORICAL + TEMPORAL)
        text = [s.column for s in steps if isinstance(df.schema[s.column].dataType, StringType)]
        share = (F.lit(1.0) / F.col(WEIGHT)).alias("share")
        tables = {}
        for step in steps:
            if step.column not in text:
                counts = count_keys(df, {"key": X.day_of(step.column)})
                tables[step.column] = freeze(counts.select("*", share), ["key"])
        if text:
            with computed_once(count_levels(df, text)) as counted:
                for c, rows in small_levels(counted).items():
                    few = [{"key": r["level"], WEIGHT: r[WEIGHT], "share": 1.0 / r[WEIGHT]} for r in rows]
                    frame = local_frame(df.sparkSession, few, f"key string, {WEIGHT} bigint, share double")
                    tables[c] = KeyedTable(frame, ("key",), True)
                for c in text:
                    if c not in tables:
                        counts = counted.filter(F.col("column") == c).select(F.col("level").alias("key"), WEIGHT, share)
                        tables[c] = freeze(counts, ["key"])
        return [FittedBalance(s.column, s.column not in text, tables[s.column]) for s in steps]


def group_count(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
