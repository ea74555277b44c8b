"""The data behind evaluation and exploration charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.schema import NUMERIC, quote, require
from coppice.operators.lookup import filter_by_dict, sample_to_cap
from coppice.operators.stats import has_duplicates
from coppice.operators.steps import select_columns
from coppice.plans.roles import Roles

PREDICTION = "prediction"


def categorical_error(df: DataFrame, actual: str, predicted: str, output: str = "error") -> DataFrame:
    """0 where prediction and actual agree, 1 otherwise, also if either is null."""
    return df.withColumn(output, F.when(F.col(actual) == F.col(predicted), 0).otherwise(1))


def numeric_error(df: DataFrame, actual: str, predicted: str, output: str = "error") -> DataFrame:
    """Relative error; null where the actual is 0."""
    return df.withColumn(output, F.try_divide(F.col(predicted) - F.col(actual), F.col(actual)))


def with_error(df: DataFrame, roles: Roles, predicted: str = PREDICTION, output: str = "error") -> DataFrame:
    measure = categorical_error if roles.target_is_categorical else numeric_error
    return measure(df, roles.target, predicted, output)


def spatial_evaluation(df: DataFrame, roles: Roles, predicted: str = PREDICTION) -> DataFrame:
    columns = [*roles.used_for_prediction, roles.target, predicted, "error"]
    return select_columns(with_error(df, roles, predicted), columns)


def check_evaluation(df: DataFrame, roles: Roles) -> None:
    """Raise ``ValueError`` if the table cannot be evaluated: roles missing or rows not unique."""
    roles.check_table(df)
    if has_duplicates(df, list(dict.fromkeys(roles.used_for_prediction))):
        raise ValueError("rows repeat in the columns used for prediction")


def group_slice(df: DataFrame, group: dict[str, object] | None) -> DataFrame:
    return df if group is None else filter_by_dict(df, group)


def scatter_set(
    df: DataFrame,
    roles: Roles,
    key: Sequence[str],
    x: str | None = None,
    color: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Target with an optional x and colour feature, sampled by ``key`` to ``cap`` rows if that is given."""
    for c in (x, color):
        if c is not None and c not in roles.features:
            raise ValueError(f"{c} is not a feature column")
    columns = [roles.target, *(c for c in (x, color) if c is not None)]
    return select_columns(df if cap is None else sample_to_cap(df, cap, key), columns)


def series_set(df: DataFrame, roles: Roles, color: str | None = None) -> DataFrame:
    return select_columns(df, [roles.date, roles.target, *([color] if color else [])])


def spatial_set(df: DataFrame, roles: Roles, place_name: str | None = None) -> DataFrame:
    return select_columns(df, [*roles.used_for_prediction, roles.target, *([place_name] if place_name else [])])


def actual_and_predicted(
    df: DataFrame, actual: str, predicted: str = PREDICTION, keep: Sequence[str] = ()
) -> DataFrame:
    """Long form with two rows per input row: ``keep``, ``value``, ``is_prediction``.

    One scan, not a union of two.
    """
    kind = df.schema[actual].dataType
    pair = F.array(
        F.struct(F.col(actual).alias("value"), F.lit(False).alias("is_prediction")),
        F.struct(F.col(predicted).cast(kind).alias("value"), F.lit(True).alias("is_prediction")),
    )
    return df.select(*keep, F.inline(pair))


def series_evaluation(df: DataFrame, roles: Roles, predicted: str = PREDICTION) -> DataFrame:
    return actual_and_predicted(df, roles.target, predicted, [roles.date])


def iid_evaluation(df: DataFrame, roles: Roles, predicted: str = PREDICTION) -> DataFrame:
    return actual_and_predicted(df, roles.target, predicted, [roles.target])


def confusion_counts(df: DataFrame, actual: str, predicted: str = PREDICTION) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., bin, n)`` over equal-width bins; a constant column is bin 0.

    The bins span the finite values. NaN and infinities share the null bin;
    nulls are left out.
    """
    require(df, [column], NUMERIC)
    value = F.col(quote(column)).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    low, high = df.agg(F.min(F.when(finite, value)), F.max(F.when(finite, value))).first()
    present = df.filter(value.isNotNull())
    if low is None or high == low:
        number = F.lit(0).cast("bigint")
    else:
        width = F.lit((high - low) / bins)
        number = F.least(F.floor((value - F.lit(low)) / width), F.lit(bins - 1).cast("bigint"))
    number = F.when(finite, number)
    return present.groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
