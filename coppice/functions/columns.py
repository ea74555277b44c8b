"""Scalar and aggregate expressions, all JVM-side."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coppice.functions.schema import quote

# Part of the date -> (period, step between phases).
SEASON_PARTS = {
    "day_of_week": (6, 1),
    "day_of_month": (31, 3),
    "week_of_year": (52.1429, 7),
    "day_of_year": (365.25, 13),
}
# Fixed value: length of a year in the decay weight, in days.
YEAR_DAYS = 360.25

MICROS_PER_DAY = 86_400_000_000


def col(value: Column | str) -> Column:
    """An expression, or a column by its plain name, whatever characters that has."""
    return value if isinstance(value, Column) else F.col(quote(value))


def to_moment(value: Column | str, type_name: str) -> Column:
    """A string, date or zone-less timestamp as timestamp; unreadable text is null."""
    if type_name == "string":
        return F.try_to_timestamp(col(value))
    return col(value).cast("timestamp")


def day_of(value: Column | str) -> Column:
    return F.to_date(col(value))


def date_part(value: Column | str, part: str) -> Column:
    """Monday-based weekday from 0, day of month, ISO week, day of year from 0."""
    c = col(value)
    if part == "day_of_week":
        return F.weekday(c)
    if part == "day_of_month":
        return F.dayofmonth(c)
    if part == "week_of_year":
        return F.weekofyear(c)
    if part == "day_of_year":
        return F.dayofyear(c) - 1
    raise ValueError(f"unknown date part {part!r}")


def season_phases(part: str) -> list[int]:
    """Phases 0, step, 2*step ... up to half the period."""
    period, step = SEASON_PARTS[part]
    return list(range(0, math.floor(period / 2) + 1, step))


def wave(value: str, period: float, phase: float, kind: str) -> str:
    """SQL text of ``sin`` or ``cos`` of ``2*pi*(value + phase) / period``.

    Text, because a date has 58 of these and one call builds them all.
    """
    return f"{kind}({2 * math.pi!r}D * ({value} + {phase}) / {float(period)!r}D)"


def decay(value: Column | str, newest: Column, annual_rate: float, year: float = YEAR_DAYS) -> Column:
    """``exp(-rate * years)`` where years count whole 24-hour periods before ``newest``."""
    if not annual_rate >= 0:
        raise ValueError(f"annual rate {annual_rate} must not be negative")
    elapsed = F.unix_micros(newest) - F.unix_micros(col(value))
    days = F.floor(elapsed / F.lit(MICROS_PER_DAY))
    weight = F.exp(F.lit(-float(annual_rate)) * days / F.lit(year))
    return F.when(elapsed < 0, F.raise_error(F.lit("date is newer than the fitted newest date"))).otherwise(weight)


def tag_text(value: Column | str) -> Column:
    """Column form of :func:`coppice.functions.schema.tag_name`."""
    return F.regexp_replace(col(value), r"[^\p{L}\p{N}]", "_")


def ratio(value: Column | str, base: Column | str) -> Column:
    """``value / base``; a null base counts as 1, a base of 0 gives null."""
    return F.try_divide(col(value), F.coalesce(col(base), F.lit(1.0)))


def add_up(columns: list[str]) -> Column:
    """Sum across columns of one row; null if any part is null."""
    if not columns:
        raise ValueError("nothing to add")
    parts = [col(c) for c in columns]
    while len(parts) > 1:  # pairwise, so that the expression stays shallow for hundreds of columns
        parts = [reduce(lambda a, b: a + b, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def strongest(value: Column | str) -> Column:
    """Aggregate: the signed value of largest magnitude; positive wins a tie.

    Magnitudes that agree in 12 decimals are a tie: the two levels of a column
    have correlations r and -r, computed along different ways.
    """
    usable = F.when(~F.isnan(col(value)), col(value))
    return F.max_by(usable, F.when(usable.isNotNull(), F.struct(F.round(F.abs(usable), 12), usable)))


def valid_place(latitude: Column | str, longitude: Column | str) -> Column:
    inside = col(latitude).between(-90, 90) & col(longitude).between(-180, 180)
    return F.coalesce(inside, F.lit(False))


def unit_hash(label: str, *key: Column | str) -> Column:
    """A repeatable number in [0, 1) that depends on the label and the key only.

    Unlike ``rand`` it does not depend on the partitioning, so a recomputed
    task, another cluster size or another engine gives the same value.
    """
    text = F.concat_ws("|", F.lit(label), *(col(k).cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def normal_hash(label: str, *key: Column | str) -> Column:
    """A repeatable standard normal number, by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - unit_hash(f"{label}/r", *key)))
    return radius * F.cos(F.lit(2 * math.pi) * unit_hash(f"{label}/a", *key))
