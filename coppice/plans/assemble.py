"""Features, target and weight, each as one chain of steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from coppice.functions.schema import quote
from coppice.operators.dates import Season
from coppice.operators.encode import FittedOrdinal, Ordinal
from coppice.operators.place import FittedPlace, PlaceFeatures
from coppice.operators.scale import Log, Ratio, ZScore
from coppice.operators.lookup import WEIGHT
from coppice.operators.steps import Chain, Constant, Fitted, FittedChain, Found, Keep, RowSum, Step
from coppice.operators.weight import Balance, Decay
from coppice.plans.roles import FeatureRoles, TargetRole, WeightRoles
from coppice.session import keep_methods_compiled


def feature_steps(roles: FeatureRoles, places: DataFrame | None = None) -> Chain:
    steps: list[Step] = [Keep(roles.numeric)]
    steps += [Ordinal(c) for c in roles.categorical]
    if roles.date:
        steps.append(Season(roles.date))
    if roles.latitude and roles.longitude:
        if places is None:
            raise ValueError("latitude and longitude features need a table of places")
        steps.append(PlaceFeatures(roles.latitude, roles.longitude, places, on_missing="null"))
    return Chain(tuple(steps))


def target_steps(roles: TargetRole) -> Chain:
    """The last output column is the label."""
    if roles.is_categorical:
        return Chain((Ordinal(roles.column),))
    steps: list[Step] = []
    column = roles.column
    if roles.log:
        steps.append(Log(column))
        column = steps[-1].output_columns[-1]
    if roles.scale_by_category:
        steps.append(ZScore(column, roles.scale_by_category))
    elif roles.scale_by_number:
        steps.append(Ratio(column, roles.scale_by_number))
    else:
        steps.append(Keep((column,)))
    return Chain(tuple(steps))


def weight_steps(roles: WeightRoles) -> Chain:
    """The last output column is the weight: the sum of the parts, or 1 without any."""
    steps: list[Step] = []
    if roles.date:
        steps += [Balance(roles.date), Decay(roles.date, roles.annual_rate)]
    steps += [Balance(c) for c in roles.groups]
    if not steps:
        return Chain((Constant(1.0),))
    steps.append(RowSum(tuple(s.output_columns[-1] for s in steps)))
    return Chain(tuple(steps))


def build_chain(chain: Chain, found: Found, previous: FittedChain | None = None) -> FittedChain:
    """Build all steps from what was found; categories keep the codes of ``previous`` and new ones are appended."""
    old = {s.column: s for s in previous.steps if isinstance(s, FittedOrdinal)} if previous else {}
    fitted = []
    for step in chain.steps:
        if isinstance(step, Ordinal) and step.column in old:
            fitted.append(old[step.column].extend_counted(found.levels(step.column).select("level", WEIGHT)))
        else:
            fitted.append(step.build(found))
    return FittedChain(tuple(fitted))


@dataclass(frozen=True)
class FittedVector(Fitted):
    """The feature columns as one vector without missing values.

    A missing or non-finite number becomes 0, with an indicator column where
    any was missing at fit. A category unseen at fit takes a code of its own.
    Codes are nominal, whatever their number, but for those in ``ordered``,
    which are split on as numbers.
    Seasonal terms are finite by construction and are only missing where
    their date is.
    """

    numeric: tuple[str, ...]
    seasonal: tuple[str, ...]
    indicated: tuple[str, ...]
    coded: tuple[str, ...]
    levels: tuple[int, ...]
    ordered: tuple[str, ...] = ()
    output: str = "features"

    @property
    def output_columns(self) -> list[str]:
        return [self.output]

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *self.seasonal, *(f"is_missing_{c}" for c in self.indicated), *self.coded]

    @property
    def bins_needed(self) -> int:
        return max([n + 1 for c, n in zip(self.coded, self.levels) if c not in self.ordered], default=2)

    @property
    def nominal(self) -> dict[int, int]:
        """Places of the codes that are categories, with their number of levels, unseen ones being one."""
        first = len(self.feature_names) - len(self.coded)
        return {first + i: n + 1 for i, (c, n) in enumerate(zip(self.coded, self.levels)) if c not in self.ordered}

    def transform(self, df: DataFrame) -> DataFrame:
        keep_methods_compiled(df.sparkSession)
        vector = array_to_vector(F.expr(f"array({', '.join(self._inputs())})"))
        return df.withColumn(self.output, vector.alias(self.output, metadata=self._attributes()))

    def compact(self, df: DataFrame, season: Season | None) -> DataFrame:
        """The vector's features as columns ``__x0``, ``__x1``..., but for the seasonal terms, which follow from the key ``__day``."""
        keep_methods_compiled(df.sparkSession)
        inputs, terms = self._inputs(), self.seasonal_places
        day = season.key() if season else F.lit(None).cast("bigint")
        return df.withColumns({f"__x{i}": F.expr(value) for i, value in enumerate(inputs) if i not in terms} | {"__day": day})

    @property
    def seasonal_places(self) -> range:
        return range(len(self.numeric), len(self.numeric) + len(self.seasonal))

    def _inputs(self) -> list[str]:
        inputs = [f"CASE WHEN {_finite(c)} THEN CAST({quote(c)} AS DOUBLE) ELSE 0D END" for c in self.numeric]
        inputs += [f"coalesce({quote(c)}, 0D)" for c in self.seasonal]
        for c in self.indicated:
            known = _finite(c) if c in self.numeric else f"{quote(c)} IS NOT NULL"
            inputs.append(f"CASE WHEN {known} THEN 0D ELSE 1D END")
        inputs += [f"CAST(coalesce({quote(c)}, {n}) AS DOUBLE)" for c, n in zip(self.coded, self.levels)]
        return inputs

    def _attributes(self) -> dict:
        """Names of the features, and which are codes of how many levels, as Spark ML reads them."""
        first_code = len(self.feature_names) - len(self.coded)
        attributes: dict[str, list[dict]] = {"numeric": [], "nominal": []}
        for i, name in enumerate(self.feature_names):
            levels = self.levels[i - first_code] + 1 if i >= first_code else None
            if levels is not None and name not in self.ordered:
                attributes["nominal"].append({"idx": i, "name": name, "num_vals": levels})
            else:
                attributes["numeric"].append({"idx": i, "name": name})
        kept = {kind: listed for kind, listed in attributes.items() if listed}
        return {"ml_attr": {"attrs": kept, "num_attrs": len(self.feature_names)}}


def _finite(column: str) -> str:
    value = f"CAST({quote(column)} AS DOUBLE)"
    return f"({value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('infinity'))"


def missing_probes(df: DataFrame, roles: FeatureRoles) -> dict[str, Column]:
    """For every feature column that may have missing values, the condition that a row has one.

    All seasonal terms are missing where the date is, so the date alone is
    looked at. Whole numbers that cannot be null need no look.
    """
    fields = {f.name: f for f in df.schema.fields}
    may = [c for c in roles.numeric if fields[c].nullable or isinstance(fields[c].dataType, FractionalType)]
    probes = {c: F.expr(f"NOT {_finite(c)}") for c in may}
    if roles.date and fields[roles.date].nullable:
        probes[roles.date] = F.col(quote(roles.date)).isNull()
    return probes


def fit_vector(features: FittedChain, missing: Sequence[str], ordered_categories: Sequence[str] = ()) -> FittedVector:
    """Lay out the vector; ``missing`` are the columns with missing values at fit.

    ``ordered_categories`` are columns whose codes are split on as numbers. What
    is missing among the features of places is seen from their table.
    """
    coded = [s for s in features.steps if isinstance(s, FittedOrdinal)]
    codes = {s.output_columns[0]: s.num_classes for s in coded}
    ordered = tuple(s.output_columns[0] for s in coded if s.column in ordered_categories)
    seasonal = [c for s in features.steps if isinstance(s, Season) for c in s.output_columns]
    numeric = [c for c in features.output_columns if c not in codes and c not in seasonal]
    if not numeric and not codes and not seasonal:
        raise ValueError("no usable feature columns")
    indicated = list(missing)
    for step in features.steps:
        if isinstance(step, FittedPlace):
            probes = [F.count_if(F.expr(f"NOT {_finite(c)}")).alias(c) for c in step.output_columns]
            counts = step.table.frame.agg(*probes).first().asDict()
            indicated += [c for c in step.output_columns if counts[c]]
    indicated = [c for c in [*numeric, *(s.column for s in features.steps if isinstance(s, Season))] if c in indicated]
    return FittedVector(tuple(numeric), tuple(seasonal), tuple(indicated), tuple(codes), tuple(codes.values()), ordered)
