"""Which column plays which part, and what follows from that."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.schema import CATEGORICAL, NUMERIC, TEMPORAL, columns_of, quote
from coppice.operators.lookup import local_frame
from coppice.operators.stats import min_value, top_correlated


@dataclass(frozen=True)
class Roles:
    target: str = "target"
    target_is_categorical: bool = False
    date: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    groups: tuple[str, ...] | None = None
    features: tuple[str, ...] | None = None

    def __post_init__(self):
        for name in ("groups", "features"):
            value = getattr(self, name)
            object.__setattr__(self, name, None if value is None else tuple(value))

    def require_features(self) -> None:
        if self.features is None:
            raise ValueError("feature columns are not set")

    @property
    def is_spatial(self) -> bool:
        return self.latitude is not None and self.longitude is not None

    @property
    def used_for_prediction(self) -> list[str]:
        self.require_features()
        place = [self.latitude, self.longitude] if self.is_spatial else []
        return [*self.features, *([self.date] if self.date else []), *place]

    def unused(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.used_for_prediction]

    def same_problem(self, other: Roles) -> bool:
        """Equal in everything but the features."""
        return replace(self, features=None) == replace(other, features=None)

    def check_table(self, df: DataFrame, prediction: bool = False) -> None:
        """Raise ``ValueError`` if a column with a role is missing or the target has the wrong type."""
        present = set(df.columns)
        if not prediction:
            if self.target not in present:
                raise ValueError(f"target {self.target} is not a column")
            if not self.target_is_categorical and self.target not in columns_of(df, NUMERIC):
                raise ValueError(f"target {self.target} is not numeric")
        wanted = {
            "date": [self.date] if self.date else [],
            "place": [self.latitude, self.longitude] if self.is_spatial else [],
            "group": self.groups or (),
            "feature": self.features or (),
        }
        for role, names in wanted.items():
            missing = [c for c in names if c not in present]
            if missing:
                raise ValueError(f"{role} columns {missing} are not in the table")


@dataclass(frozen=True)
class FeatureRoles:
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    date: str | None = None
    latitude: str | None = None
    longitude: str | None = None


@dataclass(frozen=True)
class TargetRole:
    column: str
    is_categorical: bool = False
    log: bool = False
    scale_by_category: str | None = None
    scale_by_number: str | None = None

    def __post_init__(self):
        if self.scale_by_category is not None and self.scale_by_number is not None:
            raise ValueError("a target is scaled by a category or by a number, not by both")


@dataclass(frozen=True)
class WeightRoles:
    date: str | None = None
    annual_rate: float = 0.1
    groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class ModelRoles:
    feature: FeatureRoles
    target: TargetRole
    weight: WeightRoles = field(default_factory=WeightRoles)


def feature_roles(roles: Roles, df: DataFrame) -> FeatureRoles:
    """Text features are categories, numeric ones numbers; other types are left out."""
    roles.require_features()
    chosen = df.select(*map(quote, roles.features))
    place = {"latitude": roles.latitude, "longitude": roles.longitude} if roles.is_spatial else {}
    return FeatureRoles(
        tuple(columns_of(chosen, CATEGORICAL)), tuple(columns_of(chosen, NUMERIC)), date=roles.date, **place
    )


def weight_roles(roles: Roles) -> WeightRoles:
    """A categorical target is balanced like a group."""
    groups = tuple(roles.groups or ()) + ((roles.target,) if roles.target_is_categorical else ())
    return WeightRoles(date=roles.date, groups=groups)


def target_choice(roles: Roles, df: DataFrame) -> DataFrame:
    """One row: how the target will be transformed.

    Categories are encoded. Numbers without negatives are logged. If the
    feature most correlated with the target exceeds 0.5 in magnitude, the
    target is divided by it (number) or scaled within it (category).
    """
    schema = (
        "column string, is_categorical boolean, log boolean, scale_by_category string, scale_by_number string"
    )
    empty = {"column": roles.target, "is_categorical": roles.target_is_categorical, "log": False,
             "scale_by_category": None, "scale_by_number": None}
    if roles.target_is_categorical:
        return local_frame(df.sparkSession, [empty], schema)
    roles.require_features()
    known = set(columns_of(df, NUMERIC + CATEGORICAL))
    best = top_correlated(df, roles.target, [c for c in roles.features if c in known]).filter(F.abs("corr") > 0.5)
    column = F.max("column")
    numeric = F.max(F.col("column").isin(columns_of(df, NUMERIC)))
    chosen = best.agg(F.when(~numeric, column).alias("by_category"), F.when(numeric, column).alias("by_number")).first()
    lowest = min_value(df, roles.target).first()[0]
    row = {
        **empty,
        "log": lowest is not None and lowest >= 0,
        "scale_by_category": chosen["by_category"],
        "scale_by_number": chosen["by_number"],
    }
    return local_frame(df.sparkSession, [row], schema)


def infer_model_roles(roles: Roles, df: DataFrame) -> ModelRoles:
    target = target_choice(roles, df).first()
    return ModelRoles(feature_roles(roles, df), TargetRole(**target.asDict()), weight_roles(roles))


def column_roles(
    df: DataFrame,
    target: str | None = None,
    date: str | None = None,
    latitude: str | None = None,
    longitude: str | None = None,
) -> DataFrame:
    """``(column, role)`` rows: the roles each column could take.

    Columns with at most one value are neither target nor feature; columns
    already chosen are neither feature nor, for target and date, group.
    """
    numeric, text, temporal = (columns_of(df, kinds) for kinds in (NUMERIC, CATEGORICAL, TEMPORAL))
    described = numeric + text
    chosen = {target, date, latitude, longitude}
    counts = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(described)))
    offers = []
    for i, c in enumerate(described):
        alive = F.col(f"n{i}") > 1
        offers.append((c, "target", alive))
        if c not in chosen:
            offers.append((c, "feature", alive))
    always = (
        [(c, "date") for c in text + temporal]
        + [(c, "latitude") for c in numeric]
        + [(c, "longitude") for c in numeric]
        + [(c, "group") for c in text if c not in (target, date)]
    )
    offers += [(c, role, F.lit(True)) for c, role in always]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), ok.alias("ok")) for c, r, ok in offers]
    return counts.select(F.inline(F.array(*rows))).filter("ok").select("column", "role")
