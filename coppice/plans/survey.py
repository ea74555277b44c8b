"""The statistics that training needs, gathered in one global aggregate and one grouping-sets pass.

Steps say by :meth:`~coppice.operators.steps.Step.needs` which aggregates
fitting them takes. :class:`Survey` computes those of many steps together: the
totals over all rows first, then the counts and aggregates per level of every
key column, where a row is read once for all keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.columns import strongest
from coppice.functions.schema import CATEGORICAL, NUMERIC, columns_of, quote
from coppice.operators.lookup import WEIGHT, count_levels, small_levels
from coppice.operators.scale import Log, ZScore
from coppice.operators.stats import number
from coppice.operators.steps import Found, Step
from coppice.plans.roles import Roles, TargetRole

ALL_ROWS, CENTRED = "__all_rows", "__centred"


class Survey:
    """Two passes over ``df``; aggregates of steps are over the rows with a label only."""

    def __init__(self, df: DataFrame, label: str):
        self.df = df
        self.labelled = F.col(quote(label)).isNotNull()

    def totals(self, steps: Sequence[Step], others: Mapping[str, Column]) -> dict:
        """The totals of ``steps`` over labelled rows and ``others`` over all rows, by name."""
        wanted = dict(others)
        for step in steps:
            for name, (value, aggregate) in step.needs(self.df).totals.items():
                wanted[name] = aggregate(F.when(self.labelled, value))
        names = list(wanted)
        row = self.df.agg(F.count(F.lit(1)).alias("n"), *(wanted[c].alias(f"t{i}") for i, c in enumerate(names))).first()
        return {"n": row["n"]} | {c: row[f"t{i}"] for i, c in enumerate(names)}

    @contextmanager
    def levels(self, steps: Sequence[Step], keys: Mapping[str, Column], others: Mapping[str, Column],
               totals: Mapping) -> Iterator[Found]:
        """Counts of labelled rows and aggregates per level of all keys; ``keys`` and ``others`` are wanted besides."""
        keys, values = dict(keys), {}
        for step in steps:
            needs = step.needs(self.df)
            keys |= needs.keys
            values |= needs.per_level
        if not keys:
            yield Found(self.df, totals, None, {}, {})
            return
        place = {name: f"__value_{i}" for i, name in enumerate(values)}
        narrow = self.df.select(
            *(key.cast("string").alias(name) for name, key in keys.items()), self.labelled.alias("__labelled"),
            *(F.when(self.labelled, value).alias(place[name]) for name, (value, _) in values.items()),
            *(value.alias(f"__other_{i}") for i, value in enumerate(others.values())),
        )
        extra = [F.count_if("__labelled").alias("__n")]
        extra += [aggregate(F.col(place[name])).alias(place[name]) for name, (_, aggregate) in values.items()]
        extra += [F.sum(f"__other_{i}").alias(name) for i, name in enumerate(others)]
        counted = count_levels(narrow, list(keys), extra)
        counted = counted.withColumnRenamed(WEIGHT, ALL_ROWS).withColumnRenamed("__n", WEIGHT).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield Found(self.df, totals, counted, small_levels(counted.where(F.col(WEIGHT) > 0)), place)
        finally:
            counted.unpersist()


def target_totals(roles: Roles, df: DataFrame) -> dict[str, Column]:
    """Totals that the choice of a numeric target's scaling takes: smallest value and numeric correlations."""
    target = number(roles.target)
    numeric = _candidates(roles, df, NUMERIC)
    return {"lowest": F.min(quote(roles.target)), "mean": F.avg(target), "variance": F.var_pop(target),
            "spread": F.stddev_pop(target)} | {
        f"{kind} {c}": function for c in numeric
        for kind, function in (("covariance", F.covar_pop(target, number(c))), ("spread", F.stddev_pop(number(c))))}


def _candidates(roles: Roles, df: DataFrame, kinds) -> list[str]:
    return [c for c in dict.fromkeys(roles.features) if c != roles.target and c in columns_of(df, kinds)]


def centred(roles: Roles, totals: Mapping) -> dict[str, Column]:
    """What is summed per level for the correlation of the target with that level's indicator."""
    return {CENTRED: number(roles.target) - F.lit(totals["mean"])} if totals["mean"] is not None else {}


def choose_target(roles: Roles, df: DataFrame, found: Found) -> TargetRole:
    """The scaling of a numeric target, as :func:`coppice.plans.roles.target_choice` says, from a survey."""
    totals, n = found.totals, float(max(found.totals["n"], 1))
    numeric, categorical = _candidates(roles, df, NUMERIC), _candidates(roles, df, CATEGORICAL)
    corr: dict[str, float] = {}
    if len(numeric) + len(categorical) > 1:
        for c in numeric:
            spread = (totals["spread"] or 0.0) * (totals[f"spread {c}"] or 0.0)
            if spread:
                corr[c] = totals[f"covariance {c}"] / spread
        if categorical and totals["variance"] is not None and found.counted is not None:
            share = F.col(ALL_ROWS) / F.lit(n)
            of_level = F.try_divide(F.col(CENTRED) / F.lit(n), F.sqrt(F.lit(totals["variance"]) * share * (1 - share)))
            rows = found.counted.where(F.col("column").isin(categorical) & F.col("level").isNotNull())
            for row in rows.select("column", of_level.alias("corr")).groupBy("column").agg(strongest("corr").alias("corr")).collect():
                corr[row["column"]] = row["corr"]
    usable = sorted((-abs(v), c) for c, v in corr.items() if v is not None and v == v)
    best = usable[0][1] if usable and -usable[0][0] > 0.5 else None
    lowest = totals["lowest"]
    return TargetRole(roles.target, False, lowest is not None and lowest >= 0,
                      best if best in categorical else None, best if best in numeric else None)


def scaled_targets(roles: Roles, df: DataFrame, log: bool) -> list[Step]:
    """The z-scores that may be chosen, one for each categorical feature."""
    column = Log(roles.target).output_columns[0] if log else roles.target
    return [ZScore(column, c) for c in _candidates(roles, df, CATEGORICAL)]
