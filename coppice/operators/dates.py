"""Date conversion and seasonal terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.functions.schema import TEMPORAL, quote, require
from coppice.operators.steps import Stateless
from coppice.session import keep_methods_compiled

# More than any calendar part has values, and the days after which dates, weeks and weekdays repeat.
KEY_BASE, CALENDAR_DAYS = 512, 146_097


def conform_date(df: DataFrame, column: str | None) -> DataFrame:
    """Turn a string, date or zone-less timestamp column into a timestamp."""
    if column is None:
        return df
    kind = dict(df.dtypes)[column]
    return df if kind == "timestamp" else df.withColumn(column, X.to_moment(column, kind))


def calendar_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({part: X.date_part(column, part).cast("int") for part in X.SEASON_PARTS})


@dataclass(frozen=True)
class Season(Stateless):
    """Sine and cosine terms of the date, at several phases of each calendar part.

    With all four parts these are 58 columns. They are plain expressions: no
    distinct dates, no join.
    """

    column: str
    parts: tuple[str, ...] = tuple(X.SEASON_PARTS)

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    def _terms(self) -> list[tuple[str, str, int, str]]:
        return [
            (f"season_{part}_{kind}_{phase}", part, phase, kind)
            for part in self.parts
            for phase in X.season_phases(part)
            for kind in ("sin", "cos")
        ]

    @property
    def output_columns(self) -> list[str]:
        return [name for name, *_ in self._terms()]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.column], TEMPORAL)
        keep_methods_compiled(df.sparkSession)
        kept = [c for c in df.columns if c not in self.output_columns]
        parts = df.select(
            *(F.col(quote(c)) for c in kept),
            *(X.date_part(self.column, p).cast("double").alias(f"__{p}") for p in self.parts),
        )
        return parts.selectExpr(*map(quote, kept), *self._waves())

    def _waves(self) -> list[str]:
        """The terms as SQL text, from columns of the parts."""
        return [f"{X.wave(f'__{part}', X.SEASON_PARTS[part][0], phase, kind)} AS {quote(name)}" for name, part, phase, kind in self._terms()]

    def key(self) -> Column:
        """One number for all parts of the date, null without a date: the same key, the same terms."""
        key = F.lit(0).cast("bigint")
        for part in self.parts:
            key = key * KEY_BASE + X.date_part(self.column, part)
        return key

    def calendar(self, spark: SparkSession) -> tuple[list[int], list[list[float]]]:
        """Every key that a date can have, in order, and its terms: the calendar repeats after 400 years."""
        dates = spark.range(CALENDAR_DAYS).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias(self.column))
        parts = [X.date_part(self.column, p).cast("double").alias(f"__{p}") for p in self.parts]
        keys = dates.select(self.key().alias("__key"), *parts).distinct()
        rows = keys.selectExpr("__key", f"array({', '.join(w.rsplit(' AS ', 1)[0] for w in self._waves())}) AS __waves").collect()
        found = sorted((row["__key"], row["__waves"]) for row in rows)
        return [k for k, _ in found], [w for _, w in found]
