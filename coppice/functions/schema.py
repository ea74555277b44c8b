"""Checks and selections that only look at the schema."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DataType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

NUMERIC = (NumericType,)
CATEGORICAL = (StringType,)
TEMPORAL = (TimestampType, TimestampNTZType, DateType)

Verdict = tuple[bool, list[str]]


def columns_of(df: DataFrame, kinds: Sequence[type[DataType]]) -> list[str]:
    """Names of the columns whose type is one of ``kinds``, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, tuple(kinds))]


def require(df: DataFrame, columns: Iterable[str], kinds: Sequence[type[DataType]]) -> None:
    """Raise ``TypeError`` at the first column that is not of ``kinds``."""
    ok, messages = inspect(df, columns, kinds)
    if not ok:
        raise TypeError("; ".join(messages))


def inspect(df: DataFrame, columns: Iterable[str], kinds: Sequence[type[DataType]]) -> Verdict:
    """Like :func:`require`, but report every problem instead of raising."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = "/".join(k.__name__.removesuffix("Type").lower() for k in kinds)
    messages = []
    for name in columns:
        if name not in types:
            messages.append(f"missing column {name}")
        elif not isinstance(types[name], tuple(kinds)):
            messages.append(f"column {name} is {types[name].simpleString()}, wanted {wanted}")
    return not messages, messages


def combine(verdicts: Iterable[Verdict]) -> Verdict:
    """One verdict out of many: all must hold, messages are concatenated."""
    messages = [m for _, part in verdicts for m in part]
    return not messages, messages


def quote(name: str) -> str:
    """A column name for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def tag_name(value: object) -> str:
    """A value as part of a column name: anything but letters and digits is ``_``."""
    return re.sub(r"\W", "_", str(value))


def distinct_names(names: Iterable[str]) -> list[str]:
    """Suffix repeated names with ``_2``, ``_3`` ... so that all differ."""
    used: set[str] = set()
    result = []
    for name in names:
        candidate, turn = name, 1
        while candidate in used:
            turn += 1
            candidate = f"{name}_{turn}"
        used.add(candidate)
        result.append(candidate)
    return result
