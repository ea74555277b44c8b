"""Training and scoring of tree ensembles, distributed from scan to sink."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.schema import quote
from coppice.operators.dates import Season, conform_date
from coppice.operators.encode import FittedOrdinal
from coppice.operators.lookup import local_frame
from coppice.operators.scale import FittedLog
from coppice.operators.steps import FittedChain, Step, select_columns
from coppice.plans.assemble import (
    FittedVector,
    build_chain,
    feature_steps,
    fit_vector,
    missing_probes,
    target_steps,
    weight_steps,
)
from coppice.plans.boosting import SoftmaxModel, SoftmaxTrees
from coppice.plans.contract import check_columns, feature_needs, needs_of, target_needs
from coppice.plans.forest import ForestTrees
from coppice.plans.residuals import ResidualModel, ResidualTrees
from coppice.plans.roles import ModelRoles, Roles, TargetRole, feature_roles, weight_roles
from coppice.plans.survey import Survey, centred, choose_target, scaled_targets, target_totals
from coppice.session import checkpoint_root, store_columns

logger = logging.getLogger(__name__)

LABEL, WEIGHT, SCORE, COPIES = "__label", "__row_weight", "__score", "__copies"
#: Partitions of the rows to train on: at least so many, unless given, and one for so many rows and values of features.
LEAST_PARTITIONS, ROWS_PER_PARTITION, VALUES_PER_PARTITION = 32, 500_000, 1 << 25


@dataclass(frozen=True)
class TrainParams:
    """How to train.

    ``multiclass`` is ``forest``, ``softmax`` for one boosted ensemble of all
    classes, or ``one_vs_rest`` for boosted trees per class. Rows are dealt to ``partitions`` by a hash of their values and
    sorted there, so a model depends on the rows and these parameters, not on
    files or the size of the cluster; there are at least so many, 32 without a number, and
    one for each 500,000 rows or 2^25 values of features. Categories are nominal, and the trainer keeps statistics for
    each of their levels; ``ordered_categories`` are split on by level order. Trees of a number are grown from cells
    (``ResidualTrees``), which few enough take one task and else ``partitions``, or one for each 24 MB.
    """

    trees: int = 100
    depth: int = 5
    step: float = 0.1
    bins: int = 64
    seed: int = 7
    multiclass: str = "forest"
    partitions: int | None = None
    ordered_categories: tuple[str, ...] = ()

    def draws_rows(self, num_classes: int | None) -> bool:
        """Whether the trainer draws rows at random, so that rows of unequal weight must stay apart."""
        return num_classes is not None and num_classes > 2 and self.multiclass == "forest"


@dataclass(frozen=True)
class Trained:
    roles: Roles
    model_roles: ModelRoles
    features: FittedChain
    vector: FittedVector
    target: FittedChain
    model: Model | SoftmaxModel | ResidualModel
    dropped_rows: int = 0

    def inputs(self, df: DataFrame) -> DataFrame:
        """The features as the model reads them."""
        featured = self.features.transform(df)
        return self.vector.compact(featured, season_of(self.features)) if isinstance(self.model, ResidualModel) else self.vector.transform(featured)

    @property
    def num_classes(self) -> int | None:
        last = self.target.steps[-1]
        return last.num_classes if isinstance(last, FittedOrdinal) else None


def season_of(features: FittedChain) -> Season | None:
    return next((step for step in features.steps if isinstance(step, Season)), None)


def _estimator(params: TrainParams, num_classes: int | None, vector: FittedVector):
    if num_classes is None:
        return ResidualTrees(len(vector.feature_names), vector.nominal, tuple(vector.seasonal_places), params.trees, params.depth, params.step,
                             params.bins, label=LABEL, weight=WEIGHT, output=SCORE, partitions=params.partitions)
    bins = max(params.bins, vector.bins_needed)
    if num_classes > 2 and params.multiclass == "softmax":
        return SoftmaxTrees(num_classes, vector.nominal, params.trees, params.depth, params.step, params.bins, label=LABEL,
                            weight=WEIGHT, output=SCORE, partitions=params.partitions)
    if num_classes > 2 and params.multiclass == "forest":
        return ForestTrees(num_classes, vector.nominal, params.trees, params.depth, params.bins, params.seed, label=LABEL,
                           weight=WEIGHT, copies=COPIES, output=SCORE, partitions=params.partitions)
    shared = dict(
        featuresCol="features", labelCol=LABEL, predictionCol=SCORE, maxDepth=params.depth, maxBins=bins, seed=params.seed
    )
    boosted = dict(shared, maxIter=params.trees, stepSize=params.step, weightCol=WEIGHT, checkpointInterval=10)
    if num_classes <= 2:
        return GBTClassifier(**boosted)
    if params.multiclass == "one_vs_rest":
        binary = GBTClassifier(**boosted)
        return OneVsRest(classifier=binary, featuresCol="features", labelCol=LABEL, predictionCol=SCORE, weightCol=WEIGHT)
    raise ValueError(f"unknown multiclass method {params.multiclass!r}")


def train(
    roles: Roles,
    df: DataFrame,
    params: TrainParams | None = None,
    places: DataFrame | None = None,
    previous: Trained | None = None,
    model_roles: ModelRoles | None = None,
    store_input: bool = False,
) -> Trained:
    """Fit features, target, weight and model on ``df``.

    ``previous`` keeps an earlier model's roles and category codes. Rows whose
    label or weight is null are left out and counted in ``dropped_rows``.

    ``df`` is read three times: for the totals, for counts and aggregates per
    level, and for the rows to train on. Set ``store_input`` if ``df`` is more
    than a scan, a join say: the columns with a role are then computed once and
    read from the shared folder.
    """
    params = params or TrainParams()
    roles.require_features()
    roles.check_table(df)
    checkpoint_root(df.sparkSession)
    df = conform_date(df, roles.date)
    if store_input:
        place = [roles.latitude, roles.longitude] if roles.is_spatial else []
        date = [roles.date] if roles.date else []
        df = store_columns(select_columns(df, [*roles.features, roles.target, *date, *place, *(roles.groups or ())]))
    if model_roles is None and previous:
        model_roles = previous.model_roles
    undecided = model_roles is None and not roles.target_is_categorical
    if model_roles is None:
        target_role = TargetRole(roles.target, is_categorical=roles.target_is_categorical)
        model_roles = ModelRoles(feature_roles(roles, df), target_role, weight_roles(roles))
    ok, messages = check_columns(df, needs_of(model_roles, prediction=False))
    if not ok:
        raise ValueError("\n".join(messages))

    # A null label is no class, so rows without a label are left out of what is fitted.
    label = model_roles.target.column
    surveyed = df if model_roles.target.is_categorical else FittedLog(label).transform(df)
    survey = Survey(surveyed, label)
    steps, weights = feature_steps(model_roles.feature, places), weight_steps(model_roles.weight)
    wanted: list[Step] = [*steps.steps, *weights.steps, *([] if undecided else target_steps(model_roles.target).steps)]
    probes = missing_probes(df, model_roles.feature)
    others = {f"missing {c}": F.count_if(survey.labelled & probe) for c, probe in probes.items()}
    totals = survey.totals(wanted, others | (target_totals(roles, df) if undecided else {}))
    if undecided:
        log = totals["lowest"] is not None and totals["lowest"] >= 0
        wanted += scaled_targets(roles, df, log)
    with survey.levels(wanted, {}, centred(roles, totals) if undecided else {}, totals) as found:
        if undecided:
            found.totals[f"negative {label}"] = 0  # as the choice of the logarithm has looked at
            model_roles = replace(model_roles, target=choose_target(roles, df, found))
        features = build_chain(steps, found, previous.features if previous else None)
        target = build_chain(target_steps(model_roles.target), found, previous.target if previous else None)
        weight = build_chain(weights, found)
    missing = [c for c in probes if totals[f"missing {c}"]]
    vector = fit_vector(features, missing, params.ordered_categories)
    num_classes = target.steps[-1].num_classes if model_roles.target.is_categorical else None

    if num_classes is None:  # the trainer deals cells, not rows
        rows = weighed_rows(df, model_roles, weight)[0]
    else:
        rows = dealt_rows(df, model_roles, weight, params, num_classes, totals["n"], len(vector.feature_names))
    encoded = target.transform(features.transform(rows))
    encoded = encoded.withColumn(LABEL, F.col(quote(target.output_columns[-1])).cast("double")).filter(F.col(LABEL).isNotNull())
    estimator = _estimator(params, num_classes, vector)
    if num_classes is None:
        season = season_of(features)
        model, n = estimator.fit(vector.compact(encoded, season), season and season.calendar(df.sparkSession))
        dropped = _dropped(totals["n"], n)
    else:
        ready = vector.transform(encoded).select("features", LABEL, WEIGHT, COPIES).persist()
        try:
            dropped = _dropped(totals["n"], ready.agg(F.sum(COPIES)).first()[0] or 0)
            model = estimator.fit(ready)
        finally:
            ready.unpersist()
    return Trained(roles, model_roles, features, vector, target, model, dropped)


def _dropped(n: int, used: int) -> int:
    if n - used:
        logger.warning("%d rows without a label or weight are not used for training", n - used)
    return n - used


def weighed_rows(df: DataFrame, model_roles: ModelRoles, weight: FittedChain) -> tuple[DataFrame, list[str]]:
    """The columns that features and label are made from, with each row's weight; and their names. Rows without a weight are left out."""
    needed = [*feature_needs(model_roles.feature), *target_needs(model_roles.target, prediction=False)]
    keys = list(dict.fromkeys(column for column, _, _ in needed))
    weighted = weight.transform(df).select(*(F.col(quote(c)) for c in keys), F.col(quote(weight.output_columns[-1])).cast("double").alias(WEIGHT))
    return weighted.filter(F.col(WEIGHT).isNotNull()), keys


def dealt_rows(df: DataFrame, model_roles: ModelRoles, weight: FittedChain, params: TrainParams, num_classes: int | None,
               n: int, width: int = 1) -> DataFrame:
    """The columns that features and label are made from, each row's weight and how many rows it stands for.

    Rows equal in all these columns become one, with their weights added up:
    counted map-side first, so a frequent row is no hot key. For a trainer that
    draws rows at random, only rows of the same weight do. Rows without a weight are left
    out. Dealing goes by a hash of the values, so a model does not depend on
    files or the size of the cluster. A partition gets at most 500,000 of the ``n`` rows,
    and fewer of those with many (``width``) features.
    """
    weighted, keys = weighed_rows(df, model_roles, weight)
    by = [F.col(quote(c)) for c in keys]
    if params.draws_rows(num_classes):
        each = weighted.groupBy(*by, F.col(WEIGHT).alias("__each")).agg(F.count(F.lit(1)).alias(COPIES))
        weighted, order = each.withColumn(WEIGHT, F.col("__each") * F.col(COPIES)).drop("__each"), [*by, F.col(WEIGHT)]
    else:
        # Decimals add up to the same sum in any order.
        total = F.sum(F.col(WEIGHT).cast("decimal(28,18)")).cast("double")
        weighted, order = weighted.groupBy(*by).agg(total.alias(WEIGHT), F.count(F.lit(1)).alias(COPIES)), by
    most = min(ROWS_PER_PARTITION, max(1, VALUES_PER_PARTITION // max(1, width)))
    partitions = max(params.partitions or LEAST_PARTITIONS, -(-n // most))
    return weighted.repartition(partitions, *order).sortWithinPartitions(*order)


def predict(trained: Trained, df: DataFrame, output_column: str | None = None) -> DataFrame:
    """Add the prediction, by default under the target's name. One lazy plan.

    Raises ``ValueError`` if a needed column is missing or of the wrong type;
    :func:`try_predict` returns the messages instead.
    """
    if trained.roles.date in df.columns:
        df = conform_date(df, trained.roles.date)
    ok, messages = check_columns(df, needs_of(trained.model_roles, prediction=True))
    if not ok:
        raise ValueError("\n".join(messages))
    output = output_column or trained.roles.target
    original = df.columns
    scored = trained.model.transform(trained.inputs(df))
    restored = trained.target.inverse(scored, source=SCORE, into="__restored")
    kept = [quote(c) for c in original if c != output]
    return restored.select(*kept, F.col("__restored").alias(output))


def try_predict(
    trained: Trained, df: DataFrame, output_column: str | None = None
) -> tuple[DataFrame | None, list[str]]:
    """``(predictions, messages)``; predictions are None if the table does not fit."""
    conformed = conform_date(df, trained.roles.date) if trained.roles.date in df.columns else df
    ok, messages = check_columns(conformed, needs_of(trained.model_roles, prediction=True))
    if not ok:
        return None, messages
    unused = trained.roles.unused(df)
    if unused:
        messages.append(f"unused columns: {unused}")
    return predict(trained, df, output_column), messages


def prediction_preview(df: DataFrame, roles: Roles, prediction: str = "prediction", n: int = 100) -> DataFrame:
    """Prediction first, then target, date, place, groups and features; n rows in that order's ranking."""
    if prediction not in df.columns:
        raise ValueError(f"no column {prediction}")
    columns = [prediction]
    if roles.target in df.columns:
        columns.append(roles.target)
    if roles.date:
        columns.append(roles.date)
    if roles.is_spatial:
        columns += [roles.latitude, roles.longitude]
    columns += [*(roles.groups or ()), *(roles.features or ())]
    chosen = select_columns(df, columns)
    return chosen.orderBy(*chosen.columns).limit(n)


def importances(trained: Trained) -> list[tuple[str, float]]:
    """Importance per feature; of several models the average."""
    model = trained.model
    parts = model.models if hasattr(model, "models") else [model]
    vectors = [p.featureImportances.toArray() for p in parts]
    return [(name, float(sum(v[i] for v in vectors) / len(vectors))) for i, name in enumerate(trained.vector.feature_names)]


def importance_buckets(importance: DataFrame) -> DataFrame:
    """Fold features with at most a tenth of the total of ``(name, importance)`` into one bucket.

    If all are 0 they count the same.
    """
    total, highest = importance.agg(F.sum("importance"), F.max("importance")).first()
    small = F.col("importance") <= F.lit(0.1 * (total or 0.0))
    value = F.lit(1.0) if not highest else F.col("importance")
    name = F.when(small, "other features").otherwise(F.col("name"))
    return importance.groupBy(name.alias("name")).agg(F.sum(value).alias("importance"))


def importance_table(trained: Trained) -> DataFrame:
    """:func:`importance_buckets` of a trained model."""
    spark = SparkSession.getActiveSession()
    rows = [{"name": n, "importance": v} for n, v in importances(trained)]
    return importance_buckets(local_frame(spark, rows, "name string, importance double"))
