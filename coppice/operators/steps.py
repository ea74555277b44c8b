"""The fit / transform / inverse contract, and the steps that need no fitting.

A :class:`Step` is a description. ``fit`` looks at a table and returns a
:class:`Fitted` object, which is immutable: ``transform`` adds
``output_columns``, ``inverse`` goes back. Subclass both to add your own.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import columns as X
from coppice.functions.schema import quote, tag_name
from coppice.operators.lookup import WEIGHT

#: An expression per row and the aggregate function of it.
Aggregated = tuple[Column, Callable[[Column], Column]]


class Fitted(ABC):
    @property
    @abstractmethod
    def output_columns(self) -> list[str]: ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        """Rebuild the input column from ``source`` (default: the output column)."""
        raise TypeError(f"{type(self).__name__} has no inverse")


@dataclass(frozen=True)
class Needs:
    """Aggregates that fitting a step takes, by names that mean the same in every step.

    ``totals`` are over all rows, ``per_level`` over the rows of each level of
    every one of ``keys``, whose values are texts or are read as such.
    """

    totals: Mapping[str, Aggregated] = field(default_factory=dict)
    keys: Mapping[str, Column] = field(default_factory=dict)
    per_level: Mapping[str, Aggregated] = field(default_factory=dict)


@dataclass(frozen=True)
class Found:
    """What was found for the needs of many steps: totals by name, and one row per key and level.

    ``counted`` has ``column`` (the key), ``level``, the number of rows as
    weight, and the aggregates under the names in ``place``; ``small`` the rows
    of keys with few levels.
    """

    df: DataFrame
    totals: Mapping[str, object]
    counted: DataFrame | None
    small: Mapping[str, list[dict]]
    place: Mapping[str, str]

    def levels(self, key: str) -> DataFrame:
        """The levels of a key that stand for any row."""
        return self.counted.where((F.col("column") == key) & (F.col(WEIGHT) > 0)).drop("column")


class Step(ABC):
    def needs(self, df: DataFrame) -> Needs:
        """The aggregates that :meth:`build` takes; ``df`` is looked at for its schema only."""
        return Needs()

    def build(self, found: Found) -> Fitted:
        """The fitted step from aggregates, without another look at the rows."""
        raise TypeError(f"{type(self).__name__} does not say what it needs")

    @property
    @abstractmethod
    def input_columns(self) -> list[str]: ...

    @property
    @abstractmethod
    def output_columns(self) -> list[str]: ...

    @abstractmethod
    def fit(self, df: DataFrame) -> Fitted: ...

    @classmethod
    def fit_many(cls, steps: Sequence[Step], df: DataFrame) -> list[Fitted]:
        """Fit several steps of this class on one table; override to share a pass."""
        return [step.fit(df) for step in steps]


class Stateless(Step, Fitted):
    """A step whose description is all it needs."""

    def fit(self, df: DataFrame) -> Fitted:
        return self

    def build(self, found: Found) -> Fitted:
        return self


@dataclass(frozen=True)
class Constant(Stateless):
    value: object = 1

    @property
    def input_columns(self) -> list[str]:
        return []

    @property
    def output_columns(self) -> list[str]:
        return [f"constant_{tag_name(self.value)}"]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output_columns[0], F.lit(self.value))

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        return df


@dataclass(frozen=True)
class Keep(Stateless):
    """Columns used as they are."""

    columns: tuple[str, ...]

    @property
    def input_columns(self) -> list[str]:
        return list(self.columns)

    @property
    def output_columns(self) -> list[str]:
        return list(self.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        return df

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        if source is not None:
            return df.withColumn(into or self.columns[0], X.col(source))
        return df


@dataclass(frozen=True)
class RowSum(Stateless):
    columns: tuple[str, ...]

    @property
    def input_columns(self) -> list[str]:
        return list(self.columns)

    @property
    def output_columns(self) -> list[str]:
        return ["sum_" + "+".join(self.columns)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output_columns[0], X.add_up(list(self.columns)))


@dataclass(frozen=True)
class FittedChain(Fitted):
    steps: tuple[Fitted, ...]

    @property
    def output_columns(self) -> list[str]:
        return [c for s in self.steps for c in s.output_columns]

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def inverse(self, df: DataFrame, source: str | None = None, into: str | None = None) -> DataFrame:
        for i, step in enumerate(reversed(self.steps)):
            last = i == len(self.steps) - 1
            df = step.inverse(df, source if i == 0 else None, into if last else None)
        return df


@dataclass(frozen=True)
class Chain(Step):
    """Steps in sequence; each is fitted on what the earlier ones produce."""

    steps: tuple[Step, ...]

    @property
    def input_columns(self) -> list[str]:
        needed: list[str] = []
        produced: set[str] = set()
        for step in self.steps:
            needed += [c for c in step.input_columns if c not in produced and c not in needed]
            produced.update(step.output_columns)
        return needed

    @property
    def output_columns(self) -> list[str]:
        return [c for s in self.steps for c in s.output_columns]

    def fit(self, df: DataFrame, known: Mapping[Step, Fitted] | None = None) -> FittedChain:
        """Fit all steps but the ``known`` ones.

        Steps that read source columns only are fitted on the source, those of
        one class together; the others on the output of the steps before them.
        """
        done = dict(known or {})
        produced: set[str] = set()
        direct: dict[type[Step], list[Step]] = {}
        dependent = []
        for step in self.steps:
            if step not in done:
                if all(c in df.columns and c not in produced for c in step.input_columns):
                    direct.setdefault(type(step), []).append(step)
                else:
                    dependent.append(step)
            produced.update(c for c in step.output_columns if c not in step.input_columns)
        for kind, steps in direct.items():
            done.update(zip(steps, kind.fit_many(steps, df)))
        for step in self.steps:
            if not dependent:
                break
            if step in dependent:
                done[step] = step.fit(df)
                dependent.remove(step)
            df = done[step].transform(df)
        return FittedChain(tuple(done[step] for step in self.steps))


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project without repeating a column."""
    return df.select(*map(quote, dict.fromkeys(columns)))
