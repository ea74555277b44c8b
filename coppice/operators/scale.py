"""Scaling of numeric columns: z-score, ratio, logarithm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.functions.schema import CATEGORICAL, NUMERIC, quote, require
from coppice.operators.lookup import WEIGHT, KeyedTable, attach, freeze
from coppice.operators.steps import Fitted, Found, Needs, Stateless, Step


def _spread(column: str):
    """Sample standard deviation; 1 where it is unknown."""
    return F.coalesce(F.stddev_samp(column), F.lit(1.0))


def mean_std(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """``(group, mean, stddev)`` rows; without a group the single row ``all``."""
    statistics = [F.mean(X.col(column)).cast("double").alias("mean"), _spread(X.col(column)).alias("stddev")]
    if group is None:
        return df.agg(*statistics).select(F.lit("all").alias("group"), "mean", "stddev")
    require(df, [group], CATEGORICAL)
    return df.groupBy(X.col(group).alias("group")).agg(*statistics, F.count(F.lit(1)).alias(WEIGHT))


@dataclass(frozen=True)
class FittedZScore(Fitted):
    column: str
    group: str | None
    mean: float | None = None
    stddev: float | None = None
    table: KeyedTable | None = None

    @property
    def output_columns(self) -> list[str]:
        return ZScore(self.column, self.group).output_columns

    def _with_statistics(self, df: DataFrame):
        if self.group is None:
            return df, F.lit(self.mean), F.lit(self.stddev)
        require(df, [self.group], CATEGORICAL)
        df = attach(
            df, self.table, {"group": self.group}, {"mean": "__mean", "stddev": "__stddev"}, null_safe=True
        )
        stddev = F.when(F.col("__stddev") == 0, 1.0).otherwise(F.coalesce("__stddev", F.lit(1.0)))
        return df, F.coalesce("__mean", F.lit(0.0)), stddev

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.column], NUMERIC)
        df, mean, stddev = self._with_statistics(df)
        scaled = df.withColumn(self.output_columns[0], (X.col(self.column).cast("double") - mean) / stddev)
        return scaled.drop("__mean", "__stddev")

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        source = source or self.output_columns[0]
        require(df, [source], NUMERIC)
        df, mean, stddev = self._with_statistics(df)
        return df.withColumn(into or self.column, X.col(source) * stddev + mean).drop("__mean", "__stddev")


@dataclass(frozen=True)
class ZScore(Step):
    """``(x - mean) / stddev``, overall or within a group; an unseen group counts as (0, 1)."""

    column: str
    group: str | None = None

    @property
    def input_columns(self) -> list[str]:
        return [self.column] + ([self.group] if self.group else [])

    @property
    def output_columns(self) -> list[str]:
        return [f"zscore_{self.column}" + (f"_by_{self.group}" if self.group else "")]

    def needs(self, df: DataFrame) -> Needs:
        """The column may be one that an earlier step adds, so ``df`` must have it."""
        value = F.col(quote(self.column)).cast("double")
        wanted = {f"mean {self.column}": (value, F.mean), f"stddev {self.column}": (value, F.stddev_samp)}
        if self.group is None:
            return Needs(totals=wanted)
        require(df, [self.group], CATEGORICAL)
        return Needs(keys={self.group: F.col(quote(self.group))}, per_level=wanted)

    def build(self, found: Found) -> FittedZScore:
        mean, stddev = f"mean {self.column}", f"stddev {self.column}"
        if self.group is None:
            return FittedZScore(self.column, None, found.totals[mean], found.totals[stddev] or 1.0)
        table = found.levels(self.group).select(
            F.col("level").alias("group"), F.col(found.place[mean]).alias("mean"),
            F.coalesce(found.place[stddev], F.lit(1.0)).alias("stddev"), WEIGHT)
        return FittedZScore(self.column, self.group, table=freeze(table, ["group"]))

    def fit(self, df: DataFrame) -> FittedZScore:
        require(df, [self.column], NUMERIC)
        table = mean_std(df, self.column, self.group)
        if self.group is not None:
            return FittedZScore(self.column, self.group, table=freeze(table, ["group"]))
        row = table.first()
        return FittedZScore(self.column, None, row["mean"], row["stddev"] or 1.0)


@dataclass(frozen=True)
class Ratio(Stateless):
    """A column divided by another; a null divisor counts as 1, a zero divisor gives null."""

    column: str
    base: str

    @property
    def input_columns(self) -> list[str]:
        return [self.column, self.base]

    @property
    def output_columns(self) -> list[str]:
        return [f"ratio_{self.column}_by_{self.base}"]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.input_columns, NUMERIC)
        return df.withColumn(self.output_columns[0], X.ratio(X.col(self.column).cast("double"), self.base))

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        source = source or self.output_columns[0]
        require(df, [source, self.base], NUMERIC)
        return df.withColumn(into or self.column, X.col(source) * F.coalesce(X.col(self.base), F.lit(1.0)))


def negative_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(X.col(column) < 0).alias("negatives"))


@dataclass(frozen=True)
class FittedLog(Fitted):
    column: str

    @property
    def output_columns(self) -> list[str]:
        return [f"log1p_{self.column}"]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.column], NUMERIC)
        return df.withColumn(self.output_columns[0], F.log1p(X.col(self.column).cast("double")))

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        source = source or self.output_columns[0]
        require(df, [source], NUMERIC)
        return df.withColumn(into or self.column, F.expm1(X.col(source)))


@dataclass(frozen=True)
class Log(Step):
    """``ln(1 + x)`` of a column without negative values, checked once at fit."""

    column: str

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    @property
    def output_columns(self) -> list[str]:
        return [f"log1p_{self.column}"]

    def needs(self, df: DataFrame) -> Needs:
        require(df, [self.column], NUMERIC)
        return Needs(totals={f"negative {self.column}": (F.col(quote(self.column)) < 0, F.count_if)})

    def build(self, found: Found) -> FittedLog:
        return self._checked(found.totals[f"negative {self.column}"])

    def fit(self, df: DataFrame) -> FittedLog:
        require(df, [self.column], NUMERIC)
        return self._checked(negative_count(df, self.column).first()[0])

    def _checked(self, negatives: int) -> FittedLog:
        if negatives:
            raise ValueError(f"column {self.column} has {negatives} negative values")
        return FittedLog(self.column)
