"""Categories as codes and as indicator columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.functions.schema import CATEGORICAL, NUMERIC, columns_of, distinct_names, quote, require, tag_name
from coppice.operators.lookup import (
    SALT,
    WEIGHT,
    KeyedTable,
    attach,
    computed_once,
    count_keys,
    count_levels,
    freeze,
    large_table,
    local_frame,
    number_rows,
    small_levels,
    take_small,
)
from coppice.operators.steps import Fitted, Found, Needs, Step
from coppice.session import keep_methods_compiled


def distinct_levels(df: DataFrame, column: str) -> DataFrame:
    """The levels of a non-numeric column in order, null first."""
    if column in columns_of(df, NUMERIC):
        raise TypeError(f"column {column} is numeric; levels are for categories")
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())


def num_classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, num_classes)``: distinct levels of each column, null being one."""
    counts = df.agg(
        *(
            (F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).cast("bigint").alias(f"n{i}")
            for i, c in enumerate(columns)
        )
    )
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("num_classes")) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*pairs)))


def _coded(counts: DataFrame, first: int, rows: list[dict] | None) -> tuple[KeyedTable, int]:
    """Number the levels of ``counts`` from ``first`` in order, null first.

    ``rows`` are those of ``counts`` if there are few.
    """
    if rows is None:
        order = [F.col("level").asc_nulls_first()]
        numbered, n = number_rows(counts.withColumn(SALT, F.lit(0)), order, "position")
        coded = numbered.select("level", WEIGHT, SALT, (F.col("position") + first).alias("code"))
        return large_table(coded, ["level"]), n
    rows = sorted(rows, key=lambda r: (r["level"] is not None, r["level"]))
    rows = [{**r, "code": first + i} for i, r in enumerate(rows)]
    frame = local_frame(counts.sparkSession, rows, f"level string, {WEIGHT} bigint, code bigint")
    return KeyedTable(frame, ("level",), True), len(rows)


@dataclass(frozen=True)
class FittedOrdinal(Fitted):
    column: str
    table: KeyedTable
    num_classes: int

    @property
    def output_columns(self) -> list[str]:
        return [f"ordinal_{self.column}"]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.column], CATEGORICAL)
        return attach(df, self.table, {"level": self.column}, {"code": self.output_columns[0]}, null_safe=True)

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        source = source or self.output_columns[0]
        require(df, [source], NUMERIC)
        by_code = KeyedTable(self.table.frame, ("code",), self.table.small, self.table.hot)
        return attach(df, by_code, {"code": X.col(source).cast("bigint")}, {"level": into or self.column})

    def extend(self, df: DataFrame) -> FittedOrdinal:
        """Append the levels of ``df`` not seen so far, after the known ones."""
        return self.extend_counted(count_keys(df, {"level": self.column}))

    def extend_counted(self, counts: DataFrame) -> FittedOrdinal:
        """Append the levels of ``counts`` (``level`` and weight) not seen so far."""
        known = self.table.frame.select(F.col("level").alias("known"))
        unseen = counts.join(
            F.broadcast(known) if self.table.small else known,
            F.col("level").eqNullSafe(F.col("known")),
            "left_anti",
        )
        with computed_once(unseen) as cached:
            added, n = _coded(cached, self.num_classes, take_small(cached))
        if n == 0:
            return self
        both = self.table.frame.select("level", WEIGHT, "code").unionByName(
            added.frame.select("level", WEIGHT, "code")
        )
        return FittedOrdinal(self.column, freeze(both, ["level"]), self.num_classes + n)


@dataclass(frozen=True)
class Ordinal(Step):
    """Codes 0, 1, 2 ... in level order. Null is a level; a level unseen at fit gets null."""

    column: str

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    @property
    def output_columns(self) -> list[str]:
        return [f"ordinal_{self.column}"]

    def fit(self, df: DataFrame) -> FittedOrdinal:
        return self.fit_many([self], df)[0]

    def needs(self, df: DataFrame) -> Needs:
        require(df, [self.column], CATEGORICAL)
        return Needs(keys={self.column: F.col(quote(self.column))})

    def build(self, found: Found) -> FittedOrdinal:
        rows = found.small.get(self.column)
        few = None if rows is None else [{"level": r["level"], WEIGHT: r[WEIGHT]} for r in rows]
        table, n = _coded(found.levels(self.column).select("level", WEIGHT), 0, few)
        if n == 0:
            raise ValueError(f"no rows to learn the levels of {self.column} from")
        return FittedOrdinal(self.column, table, n)

    @classmethod
    def fit_many(cls, steps: Sequence[Ordinal], df: DataFrame) -> list[FittedOrdinal]:
        columns = [s.column for s in steps]
        require(df, columns, CATEGORICAL)
        fitted = []
        with computed_once(count_levels(df, columns)) as counted:
            small = small_levels(counted)
            for c in columns:
                counts = counted.filter(F.col("column") == c).select("level", WEIGHT)
                table, n = _coded(counts, 0, small.get(c))
                if n == 0:
                    raise ValueError(f"no rows to learn the levels of {c} from")
                fitted.append(FittedOrdinal(c, table, n))
        return fitted


@dataclass(frozen=True)
class FittedOneHot(Fitted):
    column: str
    levels: tuple[str, ...]
    on_invalid: str = "error"

    @property
    def output_columns(self) -> list[str]:
        return distinct_names(f"onehot_{self.column}_is_{tag_name(v)}" for v in self.levels)

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [self.column], CATEGORICAL)
        flags = {
            name: F.when(X.col(self.column) == F.lit(level), 1).otherwise(0)
            for name, level in zip(self.output_columns, self.levels)
        }
        keep_methods_compiled(df.sparkSession)
        return df.withColumns(flags)

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        names = self.output_columns
        require(df, names, NUMERIC)
        # Arrays and not a chain over all columns: expressions stay shallow for any number of levels.
        flags = F.array(*(F.col(quote(c)).cast("double") for c in names))
        level = F.element_at(F.array(*(F.lit(v) for v in self.levels)), F.array_position(flags, 1.0).cast("int"))
        marked = F.filter(flags, lambda x: x.isNull() | (x != 0))
        single = (F.size(marked) == 1) & F.array_contains(flags, 1.0)
        level = F.when(single, level)
        if self.on_invalid != "null":
            fault = F.raise_error(F.lit("exactly one indicator must be 1"))
            level = F.when(F.coalesce(single, F.lit(False)), level).otherwise(fault)
        return df.withColumn(into or self.column, level)


@dataclass(frozen=True)
class OneHot(Step):
    """One 0/1 column per level; all are 0 for null and for a level unseen at fit.

    The columns are part of the schema, so the driver holds all levels: more
    than ``max_levels`` are an error. Use :class:`OneHotVector` then, which
    has the same indicators in one column for any number of levels.
    """

    column: str
    on_invalid: str = "error"
    max_levels: int = 20_000

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    @property
    def output_columns(self) -> list[str]:
        return []  # known after fit only

    def fit(self, df: DataFrame) -> FittedOneHot:
        require(df, [self.column], CATEGORICAL)
        level = F.col(quote(self.column)).alias("level")
        rows = df.select(level).filter(F.col("level").isNotNull()).distinct().limit(self.max_levels + 1).collect()
        if len(rows) > self.max_levels:
            raise ValueError(f"column {self.column} has more than {self.max_levels} levels for indicator columns")
        if not rows:
            raise ValueError(f"no levels in column {self.column}")
        return FittedOneHot(self.column, tuple(sorted(r["level"] for r in rows)), self.on_invalid)


@dataclass(frozen=True)
class FittedOneHotVector(Fitted):
    ordinal: FittedOrdinal
    on_invalid: str = "error"

    @property
    def output_columns(self) -> list[str]:
        return [f"onehot_{self.ordinal.column}"]

    def transform(self, df: DataFrame) -> DataFrame:
        column, output, size = self.ordinal.column, self.output_columns[0], self.ordinal.num_classes
        require(df, [column], CATEGORICAL)
        codes = local_frame(df.sparkSession, [{"__code": float(size - 1)}], "__code double")
        # A code beyond the levels is kept as a vector of zeros.
        encoder = OneHotEncoder(inputCol="__code", outputCol=output, handleInvalid="keep").fit(codes)
        coded = attach(df.drop(output), self.ordinal.table, {"level": column}, {"code": "__code"})
        coded = coded.withColumn("__code", F.coalesce(F.col("__code"), F.lit(size)).cast("double"))
        return encoder.transform(coded).drop("__code")

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        source = source or self.output_columns[0]
        require(df, [source], (VectorUDT,))
        vector = F.unwrap_udt(X.col(source))
        # Entries of a sparse vector, or all values of a dense one.
        places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
        marked = F.filter(F.arrays_zip(places.alias("place"), vector["values"].alias("value")), lambda x: x["value"] != 0)
        single = (F.size(marked) == 1) & (F.get(marked, F.lit(0))["value"] == 1)
        code = F.when(single, F.get(marked, F.lit(0))["place"].cast("bigint"))
        if self.on_invalid != "null":
            fault = F.raise_error(F.lit("exactly one indicator must be 1")).cast("bigint")
            code = F.when(F.coalesce(single, F.lit(False)), code).otherwise(fault)
        by_code = KeyedTable(self.ordinal.table.frame, ("code",), self.ordinal.table.small, self.ordinal.table.hot)
        return attach(df, by_code, {"code": code}, {"level": into or self.ordinal.column})


@dataclass(frozen=True)
class OneHotVector(Step):
    """One sparse vector with a 0/1 entry per level; all are 0 for null and for a level unseen at fit.

    Levels and codes are a keyed table, so neither the schema nor the driver
    grows with their number.
    """

    column: str
    on_invalid: str = "error"

    @property
    def input_columns(self) -> list[str]:
        return [self.column]

    @property
    def output_columns(self) -> list[str]:
        return [f"onehot_{self.column}"]

    def fit(self, df: DataFrame) -> FittedOneHotVector:
        require(df, [self.column], CATEGORICAL)
        known = df.filter(F.col(quote(self.column)).isNotNull())
        return FittedOneHotVector(Ordinal(self.column).fit(known), self.on_invalid)
