"""What a table must look like before it is trained on or scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.columns import to_moment
from coppice.functions.schema import CATEGORICAL, NUMERIC, TEMPORAL, Verdict, combine, inspect
from coppice.plans.roles import FeatureRoles, ModelRoles, TargetRole, WeightRoles

KINDS = {"numeric": NUMERIC, "categorical": CATEGORICAL, "date": TEMPORAL}

Need = tuple[str, str, str]


def feature_needs(roles: FeatureRoles) -> list[Need]:
    needs = [(c, "feature", "numeric") for c in roles.numeric]
    needs += [(c, "feature", "categorical") for c in roles.categorical]
    if roles.date:
        needs.append((roles.date, "date", "date"))
    if roles.latitude and roles.longitude:
        needs += [(roles.latitude, "latitude", "numeric"), (roles.longitude, "longitude", "numeric")]
    return needs


def target_needs(roles: TargetRole, prediction: bool) -> list[Need]:
    """The column the target is scaled by is needed for predicting too, to undo the scaling."""
    needs = []
    if not prediction:
        needs.append((roles.column, "target", "categorical" if roles.is_categorical else "numeric"))
    if roles.scale_by_category:
        needs.append((roles.scale_by_category, "scale", "categorical"))
    if roles.scale_by_number:
        needs.append((roles.scale_by_number, "scale", "numeric"))
    return needs


def weight_needs(roles: WeightRoles) -> list[Need]:
    needs = [(roles.date, "weight", "date")] if roles.date else []
    return needs + [(c, "weight", "categorical") for c in roles.groups]


def needs_of(roles: ModelRoles, prediction: bool) -> list[Need]:
    needs = feature_needs(roles.feature) + target_needs(roles.target, prediction)
    return needs if prediction else needs + weight_needs(roles.weight)


def check_columns(df: DataFrame, needs: list[Need]) -> Verdict:
    """Schema only: every needed column exists with the right type."""
    return combine(inspect(df, [column], KINDS[kind]) for column, _, kind in needs)


def input_contract(df: DataFrame, needs: list[Need]) -> DataFrame:
    """One row per need, from a single pass over the data.

    ``(column, role, present, type_ok, nulls, unreadable_dates)``. A text
    column in a date role counts the entries that are no date. Run it on the
    table as it came, before dates are conformed.
    """
    present = {c for c, _, _ in needs if c in df.columns}
    types = dict(df.dtypes)
    ordered = sorted(present)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(ordered):
        aggregates.append(F.count_if(F.col(c).isNull()).alias(f"nulls{i}"))
        bad = F.lit(False)
        if types[c] == "string" and any(n == c and kind == "date" for n, _, kind in needs):
            bad = F.col(c).isNotNull() & to_moment(c, "string").isNull()
        aggregates.append(F.count_if(bad).alias(f"bad{i}"))
    rows = []
    for column, role, kind in needs:
        here = column in present
        i = ordered.index(column) if here else -1
        ok, _ = inspect(df, [column], KINDS[kind])
        readable = ok or (here and kind == "date" and types[column] == "string")
        bad = F.col(f"bad{i}") if here and kind == "date" else F.lit(None)
        rows.append(
            F.struct(
                F.lit(column).alias("column"),
                F.lit(role).alias("role"),
                F.lit(here).alias("present"),
                F.lit(readable).alias("type_ok"),
                (F.col(f"nulls{i}") if here else F.lit(None)).cast("bigint").alias("nulls"),
                bad.cast("bigint").alias("unreadable_dates"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
