"""Boosted trees for many classes: one ensemble under a softmax, trees of a round grown together.

In every round each class gets a tree, fitted to the gradients of the softmax
loss. The trees of a round grow level by level: tasks add up gradients per
(class, node, feature, bin) over their rows, Spark sums these histograms by
key, and the best split of each node comes back, so what reaches the driver
does not depend on the number of rows, bins or features. Rows in the same bins
are one to a tree: Spark adds up their weights once, and the rounds read these
cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.lookup import local_frame
from coppice.session import materialise, store_columns

#: Rounds after which the scores are written, which cuts their lineage.
STORE_EVERY = 10
#: Gradient statistics below this are no evidence; added to every curvature.
LEAST_CURVATURE = 1e-12
#: Accuracy of the quantiles that bound the bins of a number.
QUANTILE_ACCURACY = 10_000
#: Most cells and values of them in a partition, and least number of partitions unless given.
CELLS_PER_PARTITION, VALUES_PER_PARTITION, LEAST_PARTITIONS = 1 << 17, 1 << 24, 32
#: Leaves that one machine word tells apart.
WORD = 64


@dataclass
class Tree:
    """Nodes in order of their creation; a node without a feature is a leaf.

    A row goes left if its bin is in ``levels`` (a category) or at most
    ``limit`` (a number).
    """

    feature: list[int] = field(default_factory=lambda: [-1])
    limit: list[int] = field(default_factory=lambda: [0])
    levels: list[list[int] | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, limit: int, levels: list[int] | None, values: tuple[float, float]) -> None:
        """Give a leaf two children, the right one right behind the left one."""
        self.feature[node], self.limit[node], self.levels[node], self.left[node] = feature, limit, levels, len(self.feature)
        for value in values:
            self.feature.append(-1)
            self.limit.append(0)
            self.levels.append(None)
            self.left.append(0)
            self.value.append(value)

    def leaves(self, node: int = 0) -> list[int]:
        """The leaves below a node, from left to right."""
        if self.feature[node] < 0:
            return [node]
        return self.leaves(self.left[node]) + self.leaves(self.left[node] + 1)

    @property
    def toDebugString(self) -> str:
        """The splits by bins, written as Spark does."""
        def lines(node: int, indent: str) -> list[str]:
            if self.feature[node] < 0:
                return [f"{indent}Predict: {self.value[node]}"]
            levels = self.levels[node]
            left, right = ("in", "not in") if levels is not None else ("<=", ">")
            bins = f"bin {self.limit[node]}" if levels is None else "{" + ",".join(map(str, levels)) + "}"
            return [f"{indent}If (feature {self.feature[node]} {left} {bins})", *lines(self.left[node], indent + " "),
                    f"{indent}Else (feature {self.feature[node]} {right} {bins})", *lines(self.left[node] + 1, indent + " ")]
        return "\n".join(lines(0, ""))

    def goes_left(self, node: int, value: np.ndarray) -> np.ndarray:
        return value <= self.limit[node] if self.levels[node] is None else np.isin(value, self.levels[node])


class Places:
    """Finds the leaf of many rows.

    Every bin of a feature rules out the leaves on the other side of the splits
    on it, as bits of a word; what no feature of a row rules out is its leaf.
    """

    def __init__(self, tree: Tree, sizes: tuple[int, ...]):
        self.tree, self.leaves = tree, np.array(tree.leaves())
        self.words: dict[int, np.ndarray] = {}
        if len(self.leaves) > WORD:
            return
        bit = {leaf: 1 << i for i, leaf in enumerate(self.leaves.tolist())}
        everything = sum(bit.values())
        for node, feature in enumerate(tree.feature):
            if feature >= 0:
                left, right = (sum(bit[leaf] for leaf in tree.leaves(tree.left[node] + side)) for side in (0, 1))
                kept = np.where(tree.goes_left(node, np.arange(sizes[feature])), np.uint64(everything & ~right), np.uint64(everything & ~left))
                self.words[feature] = self.words[feature] & kept if feature in self.words else kept

    def of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row, as its place among ``leaves``; ``bins`` has one row per feature."""
        if len(self.leaves) > WORD:
            return np.searchsorted(np.sort(self.leaves), self._walk(bins))
        left = None
        for feature, words in self.words.items():
            here = words[bins[feature]]
            left = here if left is None else left & here
        return np.zeros(bins.shape[1], np.int64) if left is None else np.bitwise_count(left - np.uint64(1))

    def _walk(self, bins: np.ndarray) -> np.ndarray:
        tree, at = self.tree, np.zeros(bins.shape[1], np.int64)
        for node, feature in enumerate(tree.feature):  # children stand behind their parents
            if feature >= 0:
                rows = np.flatnonzero(at == node)
                at[rows] = tree.left[node] + ~tree.goes_left(node, bins[feature, rows])
        return at

    def order(self) -> np.ndarray:
        """The nodes that the places of :meth:`of` stand for."""
        return self.leaves if len(self.leaves) <= WORD else np.sort(self.leaves)


@dataclass(frozen=True)
class Bins:
    """Upper bounds of the bins of every number; a category's code is its bin. ``sizes`` is the number of bins."""

    bounds: tuple[tuple[float, ...] | None, ...]
    sizes: tuple[int, ...]

    @classmethod
    def fit(cls, table: DataFrame, nominal: dict[int, int], wanted: int) -> Bins:
        """Bins for the column ``x`` of features, ``wanted`` at most for a number."""
        width = table.select(F.max(F.size("x"))).first()[0] or 0
        numbers = [i for i in range(width) if i not in nominal]
        shares = [k / wanted for k in range(1, wanted)]
        found = table.agg(*(F.percentile_approx(F.col("x")[i], shares, QUANTILE_ACCURACY).alias(str(i)) for i in numbers)).first() if numbers else {}
        bounds = tuple(tuple(sorted(set(found[str(i)]))) if i not in nominal else None for i in range(width))
        return cls(bounds, tuple(nominal[i] if b is None else len(b) + 1 for i, b in enumerate(bounds)))

    def cells(self, table: DataFrame, keys: str, sums: dict[str, Column], partitions: int | None, more: int) -> DataFrame:
        """``bins``, the columns of ``keys`` (DDL) and ``sums`` over the rows that agree in both, stored.

        Cells are dealt by a hash of their values and sorted, so that what is
        drawn for them does not depend on files or the size of the cluster. ``more`` is
        the number of values that a trainer will add to each.
        """
        width, names = len(self.sizes), [k.split()[0] for k in keys.split(", ")]
        others = [f for f in table.schema.fields if f.name != "x"]

        def binned(batches):
            for batch in batches:
                if batch.num_rows:
                    found = self.of(_matrix(batch.column("x"), width))
                    yield pa.RecordBatch.from_arrays([_lists(found), *(batch.column(f.name) for f in others)], ["bins", *(f.name for f in others)])

        schema = ", ".join(["bins array<int>", *(f"{f.name} {f.dataType.simpleString()}" for f in others)])
        summed = table.mapInArrow(binned, schema).groupBy("bins", *names).agg(*(c.alias(n) for n, c in sums.items())).persist()
        most = min(CELLS_PER_PARTITION, max(1, VALUES_PER_PARTITION // (width + more)))
        dealt = summed.repartition(max(partitions or LEAST_PARTITIONS, -(-summed.count() // most)), "bins", *names)
        cells = materialise(dealt.sortWithinPartitions("bins", *names))  # the many small jobs on them plan fast without their lineage
        summed.unpersist()
        return cells

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(rows.shape, np.int32)
        for i, (bounds, size) in enumerate(zip(self.bounds, self.sizes)):
            if bounds is None:
                out[:, i] = np.clip(rows[:, i], 0, size - 1)
            else:
                out[:, i] = np.searchsorted(bounds, rows[:, i], side="left")
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _by_feature(found: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(found.T, dtype=np.intp)


def _softmax(scores: np.ndarray) -> np.ndarray:
    power = np.exp(scores - scores.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class SoftmaxTrees:
    """``rounds`` trees for each of ``classes``. ``nominal`` has the number of levels of the features that are codes."""

    classes: int
    nominal: dict[int, int]
    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    bins: int = 64
    features: str = "features"
    label: str = "label"
    weight: str = "weight"
    output: str = "prediction"
    partitions: int | None = None

    def fit(self, rows: DataFrame) -> SoftmaxModel:
        """Train on all rows; ``rows`` should be persisted, as it is read twice."""
        table = rows.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("label"),
                            F.col(self.weight).cast("double").alias("weight"))
        bins = Bins.fit(table, self.nominal, self.bins)
        width, classes = len(bins.sizes), self.classes
        # Decimals add up to the same sum in any order.
        total = F.sum(F.col("weight").cast("decimal(28,18)")).cast("double")
        cells = bins.cells(table, "label int", {"weight": total}, self.partitions, classes)

        def start(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(np.zeros((batch.num_rows, classes)))], [*batch.schema.names, "scores"])

        schema = "bins array<int>, label int, weight double, scores array<double>"
        state = cells.mapInArrow(start, schema).persist()
        trees: list[list[Tree]] = []
        gains = np.zeros(width)
        for number in range(self.rounds):
            grown = self._grow(state, bins, gains)
            trees.append(grown)
            if number + 1 == self.rounds:
                break

            def advance(batches, grown=grown):
                places = [Places(tree, bins.sizes) for tree in grown]
                for batch in batches:
                    if batch.num_rows:
                        found, scores = _by_feature(_matrix(batch.column(0), width)), _matrix(batch.column(3), classes).copy()
                        for k, (tree, place) in enumerate(zip(grown, places)):
                            scores[:, k] += np.array(tree.value)[place.order()][place.of(found)]
                        yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(scores)], names=batch.schema.names)

            following = state.mapInArrow(advance, schema)
            if (number + 1) % STORE_EVERY == 0:
                following = store_columns(following)
            following = following.persist()
            following.count()
            state.unpersist()
            state = following
        state.unpersist()
        total = gains.sum()
        return SoftmaxModel(bins, trees, gains / total if total else gains, self.features, self.output)

    def _grow(self, state: DataFrame, bins: Bins, gains: np.ndarray) -> list[Tree]:
        trees = [Tree() for _ in range(self.classes)]
        active = [[0] for _ in range(self.classes)]
        for _ in range(self.depth):
            found = self._splits(state, bins, trees, active)
            active = [[] for _ in range(self.classes)]
            for row in sorted(found, key=lambda r: (r["class"], r["node"])):
                tree = trees[row["class"]]
                tree.split(row["node"], row["feature"], row["bound"], row["levels"],
                           (self.step * row["left_value"], self.step * row["right_value"]))
                active[row["class"]] += [len(tree.feature) - 2, len(tree.feature) - 1]
                gains[row["feature"]] += row["gain"]
            if not any(active):
                break
        return trees

    def _splits(self, state: DataFrame, bins: Bins, trees: list[Tree], active: list[list[int]]):
        """The best split of every active node that has one: at most one row per node."""
        width, classes = len(bins.sizes), self.classes
        starts = np.concatenate([[0], np.cumsum(bins.sizes)]).astype(np.int64)
        total = int(starts[-1])

        def histograms(batches):
            sums: dict[int, np.ndarray] = {}
            places = [Places(tree, bins.sizes) for tree in trees]
            for batch in batches:
                if not batch.num_rows:
                    continue
                found, scores = _matrix(batch.column(0), width), _matrix(batch.column(3), classes)
                label, weight = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                chance = _softmax(scores)
                cells, by_feature = found + starts[:-1], _by_feature(found)
                for k, (tree, nodes) in enumerate(zip(trees, active)):
                    if not nodes:
                        continue
                    slot = np.full(len(tree.feature), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[places[k].order()][places[k].of(by_feature)]
                    here = at >= 0
                    cell = (at[here, None] * total + cells[here]).ravel()
                    gradient = weight * (chance[:, k] - (label == k))
                    curvature = weight * chance[:, k] * (1 - chance[:, k]) * classes / (classes - 1)
                    size = len(nodes) * total
                    part = [np.bincount(cell, np.repeat(v[here], width), size) for v in (gradient, curvature)]
                    sums[k] = np.stack(part) + sums.get(k, 0.0)
            for k, both in sums.items():
                cell = np.flatnonzero(both[1])
                place = cell % total
                feature = np.searchsorted(starts, place, side="right") - 1
                yield pa.RecordBatch.from_pydict({
                    "class": pa.array(np.full(len(cell), k, np.int32)), "node": pa.array(np.array(active[k], np.int32)[cell // total]),
                    "feature": pa.array(feature.astype(np.int32)), "bin": pa.array((place - starts[feature]).astype(np.int32)),
                    "g": pa.array(both[0, cell]), "h": pa.array(both[1, cell])})

        nominal = set(self.nominal)

        def best(table: pa.Table) -> pa.Table:
            """Of one node, over its bins: numbers in order, categories by the mean of their gradients."""
            columns = {n: table[n].to_numpy() for n in ("feature", "bin", "g", "h")}
            chosen = None
            for f in np.unique(columns["feature"]):
                mine = columns["feature"] == f
                b, g, h = (columns[n][mine] for n in ("bin", "g", "h"))
                order = np.lexsort((b, g / (h + LEAST_CURVATURE))) if f in nominal else np.argsort(b)
                b, g, h = b[order], np.cumsum(g[order]), np.cumsum(h[order])
                G, H = g[-1], h[-1]
                gain = g[:-1] ** 2 / (h[:-1] + LEAST_CURVATURE) + (G - g[:-1]) ** 2 / (H - h[:-1] + LEAST_CURVATURE) - G**2 / (H + LEAST_CURVATURE)
                gain[(h[:-1] <= LEAST_CURVATURE) | (H - h[:-1] <= LEAST_CURVATURE)] = 0
                if len(gain) and (chosen is None or gain.max() > chosen["gain"]):
                    i = int(gain.argmax())
                    if gain[i] > LEAST_CURVATURE * max(H, 1):
                        chosen = {"class": table["class"][0].as_py(), "node": table["node"][0].as_py(), "feature": int(f),
                                  "bound": int(b[i]), "levels": sorted(b[: i + 1].tolist()) if f in nominal else None, "gain": float(gain[i]),
                                  "left_value": float(-g[i] / h[i]), "right_value": float(-(G - g[i]) / (H - h[i]))}
            return pa.Table.from_pylist([chosen] if chosen else [], pa.schema([
                ("class", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bound", pa.int32()), ("levels", pa.list_(pa.int32())),
                ("gain", pa.float64()), ("left_value", pa.float64()), ("right_value", pa.float64())]))

        summed = state.mapInArrow(histograms, "class int, node int, feature int, bin int, g double, h double").groupBy(
            "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        return summed.groupBy("class", "node").applyInArrow(
            best, "class int, node int, feature int, bound int, levels array<int>, gain double, left_value double, right_value double").collect()


class SoftmaxModel:
    """A fitted ensemble; ``transform`` adds the class of the highest score, the first of equal ones."""

    def __init__(self, bins: Bins, trees: list[list[Tree]], importances: np.ndarray, features: str, output: str):
        self.bins, self.trees = bins, trees
        self.featureImportances = DenseVector(importances)
        self.features, self.output = features, output

    @cached_property
    def _places(self) -> list[list[Places]]:
        return [[Places(tree, self.bins.sizes) for tree in grown] for grown in self.trees]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        found = _by_feature(self.bins.of(rows))
        out = np.zeros((len(rows), len(self.trees[0])))
        for grown, places in zip(self.trees, self._places):
            for k, (tree, place) in enumerate(zip(grown, places)):
                out[:, k] += np.array(tree.value)[place.order()][place.of(found)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        kind, parts = type(self), (self.bins, self.trees, self.featureImportances.toArray(), self.features, self.output)
        held = df.sparkSession.sparkContext.broadcast(parts)

        @F.arrow_udf("double")
        def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = kind(*held.value)
            for x in batches:
                rows = _matrix(x, len(model.bins.sizes))
                yield pa.array(model.scores(rows).argmax(axis=1).astype(float) if len(rows) else np.zeros(0))

        return df.withColumn(self.output, predicted(vector_to_array(self.features)))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for the bins and one for each tree."""
        head = {"bounds": self.bins.bounds, "sizes": self.bins.sizes, "importances": self.featureImportances.toArray().tolist(),
                "features": self.features, "output": self.output}
        rows = [{"round": -1, "class": -1, "part": json.dumps(head)}]
        rows += [{"round": r, "class": k, "part": json.dumps(vars(tree))} for r, grown in enumerate(self.trees) for k, tree in enumerate(grown)]
        local_frame(spark, rows, "round int, class int, part string").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxModel:
        head, *parts = sorted((r["round"], r["class"], r["part"]) for r in spark.read.parquet(path).collect())
        facts = json.loads(head[2])
        trees: list[list[Tree]] = []
        for number, _, part in parts:
            if number == len(trees):
                trees.append([])
            trees[number].append(Tree(**json.loads(part)))
        bins = Bins(tuple(None if b is None else tuple(b) for b in facts["bounds"]), tuple(facts["sizes"]))
        return cls(bins, trees, np.array(facts["importances"]), facts["features"], facts["output"])
