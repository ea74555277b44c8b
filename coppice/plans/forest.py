"""A random forest for many classes, all trees grown together from counted rows.

A tree of a forest sees each row as often as it is drawn, a Poisson number
around one. The draws of n equal rows add up to a Poisson number around n, so
rows of the same bins, class and weight are counted once by Spark and drawn
together: the same forest in distribution, and the levels read cells whose
number is bounded by the bins, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.boosting import Bins, Places, SoftmaxModel, Tree, _by_feature, _lists, _matrix

#: Sums that a task keeps at once; a level with more takes several passes.
SUMS_PER_PASS = 1 << 23
#: A split must lower the impurity by this share at least.
LEAST_GAIN = 1e-12


def _impurity(sums: np.ndarray) -> np.ndarray:
    """Gini impurity times weight, along the last axis."""
    weight = sums.sum(axis=-1)
    return weight - (sums**2).sum(axis=-1) / np.maximum(weight, 1e-300)


@dataclass(frozen=True)
class ForestTrees:
    """``trees`` for ``classes``; one tree alone takes all rows and features, more draw rows and, for every node, features."""

    classes: int
    nominal: dict[int, int]
    trees: int = 100
    depth: int = 5
    bins: int = 64
    seed: int = 7
    features: str = "features"
    label: str = "label"
    weight: str = "weight"
    copies: str = "copies"
    output: str = "prediction"
    partitions: int | None = None

    def fit(self, rows: DataFrame) -> ForestModel:
        """Train on all rows; ``weight`` is that of all ``copies`` of a row. ``rows`` should be persisted, as it is read twice."""
        copies = F.col(self.copies).cast("bigint")
        table = rows.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("label"),
                            (F.col(self.weight).cast("double") / copies).alias("weight"), copies.alias("copies"))
        bins = Bins.fit(table, self.nominal, self.bins)
        cells = bins.cells(table, "label int, weight double", {"copies": F.sum("copies")}, self.partitions, self.trees)
        n, seed = self.trees, self.seed

        def draw(batches):
            random = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for batch in batches:
                count = batch.column("copies").to_numpy()
                drawn = random.poisson(count[:, None], (len(count), n)) if n > 1 else count[:, None]
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(drawn.astype(float))], [*batch.schema.names, "drawn"])

        state = cells.mapInArrow(draw, "bins array<int>, label int, weight double, copies bigint, drawn array<double>").persist()
        try:
            trees, gains = self._grow(state, bins)
        finally:
            state.unpersist()
        gains = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)  # every tree counts the same
        total = gains.sum()
        return ForestModel(bins, [[tree] for tree in trees], gains.sum(axis=0) / total if total else gains.sum(axis=0), self.features, self.output)

    def _grow(self, state: DataFrame, bins: Bins) -> tuple[list[Tree], np.ndarray]:
        trees = [Tree(value=[[1 / self.classes] * self.classes]) for _ in range(self.trees)]
        gains = np.zeros((self.trees, len(bins.sizes)))
        active: dict[int, list[int]] = {t: [0] for t in range(self.trees)}
        for _ in range(self.depth):
            found = [row for part in self._parts(active, bins) for row in self._splits(state, bins, trees, part)]
            active = {}
            for row in sorted(found, key=lambda r: (r["tree"], r["node"])):
                tree = trees[row["tree"]]
                if row["node"] == 0:
                    tree.value[0] = row["shares"]
                if row["feature"] is None:
                    continue
                tree.split(row["node"], row["feature"], row["bound"], row["levels"], (row["left_shares"], row["right_shares"]))
                active.setdefault(row["tree"], []).extend([len(tree.feature) - 2, len(tree.feature) - 1])
                gains[row["tree"], row["feature"]] += row["gain"]
            if not active:
                break
        return trees, gains

    def _parts(self, active: dict[int, list[int]], bins: Bins) -> Iterator[dict[int, list[int]]]:
        """Nodes of whose histograms a task can keep all at once."""
        most = max(1, SUMS_PER_PASS // (sum(bins.sizes) * self.classes))
        nodes = [(t, node) for t, mine in active.items() for node in mine]
        for first in range(0, len(nodes), most):
            part: dict[int, list[int]] = {}
            for t, node in nodes[first : first + most]:
                part.setdefault(t, []).append(node)
            yield part

    def _splits(self, state: DataFrame, bins: Bins, trees: list[Tree], active: dict[int, list[int]]):
        """The best split of every node, without a feature if it has none: one row per node."""
        width, classes, nominal, seed = len(bins.sizes), self.classes, set(self.nominal), self.seed
        starts = np.concatenate([[0], np.cumsum(bins.sizes)]).astype(np.int64)
        size = int(starts[-1]) * classes
        grown = {t: trees[t] for t in active}
        tried = width if self.trees == 1 else int(np.ceil(np.sqrt(width)))

        def histograms(batches):
            sums = {t: np.zeros(len(nodes) * size) for t, nodes in active.items()}
            places = {t: Places(tree, bins.sizes) for t, tree in grown.items()}
            slots = {}
            for t, nodes in active.items():
                slots[t] = np.full(len(grown[t].feature), -1)
                slots[t][nodes] = np.arange(len(nodes))
                slots[t] = slots[t][places[t].order()]
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = _by_feature(_matrix(batch.column("bins"), width))
                cell = (found + starts[:-1, None]) * classes + batch.column("label").to_numpy()
                weight = batch.column("weight").to_numpy()
                drawn = np.ascontiguousarray(_matrix(batch.column("drawn"), self.trees).T)
                for t, nodes in active.items():
                    at = slots[t][places[t].of(found)]
                    here = np.flatnonzero((at >= 0) & (drawn[t] > 0))
                    first, mass = at[here] * size, weight[here] * drawn[t][here]
                    for f in range(width):
                        sums[t] += np.bincount(first + cell[f][here], mass, len(nodes) * size)
            rows = [(t, node, part) for t, nodes in active.items() for node, part in zip(nodes, sums[t].reshape(-1, size)) if part.any()]
            if rows:
                kept = [pa.array(np.flatnonzero(part).astype(np.int32)) for _, _, part in rows]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([t for t, _, _ in rows], pa.int32()), "node": pa.array([node for _, node, _ in rows], pa.int32()),
                    "place": pa.array([k.to_numpy() for k in kept], pa.list_(pa.int32())),
                    "mass": pa.array([part[k.to_numpy()] for k, (_, _, part) in zip(kept, rows)], pa.list_(pa.float64()))})

        def best(table: pa.Table) -> pa.Table:
            """Of one node, over a few features: numbers in order, categories by the share of each class."""
            t, node = table["tree"][0].as_py(), table["node"][0].as_py()
            places, masses = (table[c].combine_chunks().flatten().to_numpy() for c in ("place", "mass"))
            sums = np.bincount(places, masses, size).reshape(-1, classes)
            whole = sums[: starts[1]].sum(axis=0)
            at_node = _impurity(whole)
            chosen = {"tree": t, "node": node, "shares": (whole / whole.sum()).tolist(), "gain": LEAST_GAIN * max(whole.sum(), 1e-300)}
            features = np.random.default_rng([seed, t, node]).permutation(width)[:tried]
            for f in sorted(features.tolist()):
                mine = sums[starts[f] : starts[f + 1]]
                present = np.flatnonzero(mine.sum(axis=1))
                mine = mine[present]
                orders = [np.arange(len(present))]
                if f in nominal:
                    share = mine / mine.sum(axis=1, keepdims=True)
                    orders = [np.lexsort((present, share[:, k])) for k in range(1 if classes == 2 else classes)]
                for order in orders:
                    left = np.cumsum(mine[order], axis=0)[:-1]
                    right = whole - left
                    gain = at_node - _impurity(left) - _impurity(right)
                    if len(gain) and gain.max() > chosen["gain"]:
                        i = int(gain.argmax())
                        chosen |= {"feature": f, "bound": int(present[order[i]]), "gain": float(gain[i]),
                                   "levels": sorted(present[order[: i + 1]].tolist()) if f in nominal else None,
                                   "left_shares": (left[i] / left[i].sum()).tolist(), "right_shares": (right[i] / right[i].sum()).tolist()}
            shares = pa.list_(pa.float64())
            return pa.Table.from_pylist([chosen], pa.schema([
                ("tree", pa.int32()), ("node", pa.int32()), ("shares", shares), ("feature", pa.int32()), ("bound", pa.int32()),
                ("levels", pa.list_(pa.int32())), ("gain", pa.float64()), ("left_shares", shares), ("right_shares", shares)]))

        parts = state.mapInArrow(histograms, "tree int, node int, place array<int>, mass array<double>")
        return parts.groupBy("tree", "node").applyInArrow(
            best, "tree int, node int, shares array<double>, feature int, bound int, levels array<int>, gain double, "
                  "left_shares array<double>, right_shares array<double>").collect()


class ForestModel(SoftmaxModel):
    """A fitted forest; its trees give shares of the classes, which add up to the scores."""

    def scores(self, rows: np.ndarray) -> np.ndarray:
        found = _by_feature(self.bins.of(rows))
        out = np.zeros((len(rows), len(self.trees[0][0].value[0])))
        for (tree,), (place,) in zip(self.trees, self._places):
            out += np.array(tree.value)[place.order()][place.of(found)]
        return out
