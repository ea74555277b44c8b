"""Boosted trees for a number, each fitted to what the trees before it leave over, from counted rows.

To a tree, rows in the same bins are one: Spark adds up their weights and
weighted labels once, and the trees read these cells. Features that follow from
one column, as the seasonal terms do from the date, stand in a cell as that
column's key; a split looks them up in a table of keys. Features of few bins
share one number. So a cell is a few bytes, whatever the number of features,
and a level adds up two sums per cell and such number. Cells lie in blocks, as
arrays, in persisted partitions, which are rewritten once per tree. What
reaches the driver is the best split of each node.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, TaskContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.lookup import local_frame
from coppice.plans.boosting import STORE_EVERY, WORD, Tree
from coppice.session import materialise

#: Values that features of few bins may take together.
JOINT = 1 << 14
#: The key of the day, and what stands for none.
DAY, NO_DAY = "__day", -1
#: Values read in one piece.
VALUES_PER_BLOCK = 1 << 20
#: Bytes of cells in a block and, at most, in a partition; partitions unless given; sums that a task keeps at once.
BLOCK, PARTITION, LEAST_PARTITIONS, SUMS_PER_PASS = 1 << 22, 24 << 20, 32, 1 << 23
#: Bytes of cells that one task holds alone; sums of all partitions that the driver adds up.
NEAR, SUMS_ON_DRIVER = 1 << 25, 1 << 19
#: A split must gain this share of its sides at least; less is rounding.
LEAST_GAIN = 1e-12
#: Gains that differ by a smaller share are equal.
TIE = 1e-9
#: Bits of a number that a pass of the quantiles tells apart.
STEPS = (16, 12, 12, 12, 12)


def _sortable(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(sortable: int) -> float:
    bits = sortable ^ (1 << 63) if sortable >> 63 else ~sortable & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as arrays of bytes, some rows in each: read several times, they need no conversion any more. A null is a day that is none."""
    def blocks(batches):
        for held in _gathered(batches, VALUES_PER_BLOCK // len(columns)):
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([pa.array([table[c].fill_null(NO_DAY).to_numpy().tobytes()], pa.binary()) for c in columns], columns)

    return rows.select(*columns).mapInArrow(blocks, ", ".join(f"`{c}` binary" for c in columns))


def _gathered(batches, least: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= least:
            yield held
            held = []
    if held:
        yield held


def _arrays(batches, columns: list[str], whole: str | None = None) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each block; ``whole`` has whole numbers."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: np.frombuffer(batch.column(c)[k].as_buffer(), np.int64 if c == whole else np.float64) for c in columns}


def quantiles(blocks: DataFrame, columns: list[str], ranks: list[int]) -> list[list[float]]:
    """The values of each of the :func:`packed` columns at ``ranks``, from 1; exact, so they do not depend on files or partitions.

    Numbers are counted by their leading bits; of those around a rank the next bits are looked at.
    """
    heads = [[0] for _ in columns]  # per column the leading bits that a rank has
    wanted = [[(0, rank) for rank in ranks] for _ in columns]
    left = 64
    for bits in STEPS:
        left -= bits

        def count(batches):
            sums = [np.zeros(len(mine) << bits, np.int64) for mine in heads]
            known = [np.array(mine, np.uint64) for mine in heads]
            for block in _arrays(batches, columns):
                for i, name in enumerate(columns):
                    numbers = _sortable(block[name]) >> np.uint64(left)
                    head = numbers >> np.uint64(bits)
                    at = np.minimum(np.searchsorted(known[i], head), len(known[i]) - 1)
                    here = known[i][at] == head
                    low = (numbers & np.uint64((1 << bits) - 1)).astype(np.int64)
                    sums[i] += np.bincount((at[here] << bits) + low[here], minlength=len(sums[i]))
            for i, counted in enumerate(sums):
                place = np.flatnonzero(counted)
                yield pa.RecordBatch.from_pydict({"feature": pa.array([i], pa.int32()), "place": pa.array([place], pa.list_(pa.int64())),
                                                  "n": pa.array([counted[place]], pa.list_(pa.int64()))})

        def find(found: pa.Table) -> pa.Table:
            i = found["feature"][0].as_py()
            places, n = (found[c].combine_chunks().flatten().to_numpy() for c in ("place", "n"))
            counted = np.zeros(len(heads[i]) << bits, np.int64)
            np.add.at(counted, places, n)
            below = np.cumsum(counted.reshape(-1, 1 << bits), axis=1)
            rows = []
            for k, (head, rank) in enumerate(wanted[i]):
                mine = below[heads[i].index(head)]
                low = int(np.searchsorted(mine, rank))
                rows.append({"feature": i, "k": k, "head": str((head << bits) + low), "rank": int(rank - (mine[low - 1] if low else 0))})
            return pa.Table.from_pylist(rows, pa.schema([("feature", pa.int32()), ("k", pa.int32()), ("head", pa.string()), ("rank", pa.int64())]))

        counts = blocks.select(*columns).mapInArrow(count, "feature int, place array<bigint>, n array<bigint>")
        found = counts.groupBy("feature").applyInArrow(find, "feature int, k int, head string, rank bigint").collect()
        for row in found:
            wanted[row["feature"]][row["k"]] = (int(row["head"]), row["rank"])
        heads = [sorted({head for head, _ in mine}) for mine in wanted]
    return [[_value(head) for head, _ in mine] for mine in wanted]


@dataclass(frozen=True)
class Layout:
    """How features stand in a cell.

    ``bounds`` are the upper bounds of the bins of every number, None for a
    code; ``sizes`` the number of bins. The features at ``seasonal`` follow from
    a key: ``bins`` has a row of them for each of ``keys``, in order, and one for no key.
    """

    bounds: tuple[tuple[float, ...] | None, ...]
    sizes: tuple[int, ...]
    seasonal: tuple[int, ...] = ()
    keys: tuple[int, ...] = ()
    bins: np.ndarray | None = None

    @cached_property
    def loose(self) -> list[int]:
        return [i for i in range(len(self.sizes)) if i not in set(self.seasonal)]

    @cached_property
    def units(self) -> list[tuple[int, ...]]:
        """Features with a number of their own: each loose one, and all seasonal ones together."""
        return [(i,) for i in self.loose] + ([self.seasonal] if self.seasonal else [])

    def unit_size(self, unit: int) -> int:
        return self.sizes[self.units[unit][0]] if unit < len(self.loose) else len(self.keys) + 1

    @cached_property
    def joint(self) -> list[list[int]]:
        """Units that share a number, the first one counting fastest."""
        groups: list[list[int]] = []
        room: list[int] = []
        for unit in sorted(range(len(self.units)), key=lambda u: (-self.unit_size(u), u)):
            size = self.unit_size(unit)
            at = next((g for g, free in enumerate(room) if size <= free), None)
            if at is None:
                groups.append([unit])
                room.append(JOINT // size)
            else:
                groups[at].append(unit)
                room[at] //= size
        return groups

    @cached_property
    def joint_sizes(self) -> list[int]:
        return [int(np.prod([self.unit_size(u) for u in units])) for units in self.joint]

    @cached_property
    def kinds(self) -> list[np.dtype]:
        return [np.dtype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32) for n in self.joint_sizes]

    @cached_property
    def unit_starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([self.unit_size(u) for u in range(len(self.units))])]).astype(np.int64)

    def codes(self, column, day) -> list[np.ndarray]:
        """The numbers of rows whose features ``column`` gives by place; ``day`` gives keys."""
        found = {}
        for unit, (i, *_) in enumerate(self.units[: len(self.loose)]):
            bounds = self.bounds[i]
            values = column(i)
            found[unit] = np.clip(values, 0, self.sizes[i] - 1).astype(np.int64) if bounds is None else np.searchsorted(bounds, values, side="left")
        if self.seasonal:
            key, known = day(), np.array(self.keys, np.int64)
            found[len(self.loose)] = np.where(key == NO_DAY, len(known), np.searchsorted(known, key))
        out = []
        for units, kind in zip(self.joint, self.kinds):
            code, step = 0, 1
            for u in units:
                code = code + found[u] * step
                step *= self.unit_size(u)
            out.append(code.astype(kind))
        return out

    def marginals(self, group: int, sums: np.ndarray) -> dict[int, np.ndarray]:
        """Sums per unit, from ``sums`` with a row for each node over the numbers of a group."""
        units = self.joint[group]
        shape = [self.unit_size(u) for u in reversed(units)]
        spread = sums.reshape(len(sums), *shape)
        axes = range(1, len(units) + 1)
        return {u: spread.sum(axis=tuple(a for a in axes if a != len(units) - i)) for i, u in enumerate(units)}

    @cached_property
    def _by_bin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys in the order of their bins, feature after feature; where a bin starts, its feature and itself."""
        order = np.argsort(self.bins, axis=0, kind="stable").T
        bins = np.take_along_axis(self.bins.T, order, axis=1)
        first = np.concatenate([np.ones((len(bins), 1), bool), bins[:, 1:] != bins[:, :-1]], axis=1)
        feature, place = np.nonzero(first)
        return order.ravel(), np.flatnonzero(first), feature, bins[feature, place]

    def ordered(self, sums: np.ndarray, numbers: list[int]) -> np.ndarray:
        """The sums of all units by feature and bin, for the ``numbers`` among the features."""
        row = {feature: k for k, feature in enumerate(numbers)}
        out = np.zeros((len(sums), len(numbers), max(self.sizes[i] for i in numbers)))
        for u, (feature, *_) in enumerate(self.units[: len(self.loose)]):
            if feature in row:
                out[:, row[feature], : self.sizes[feature]] = sums[:, self.unit_starts[u] : self.unit_starts[u + 1]]
        if self.seasonal:
            order, starts, feature, bins = self._by_bin
            rows = np.array([row[i] for i in self.seasonal])[feature]
            out[:, rows, bins] = np.add.reduceat(sums[:, self.unit_starts[-2] :][:, order], starts, axis=1)
        return out

    def by_unit(self, unit: int, of_bin) -> np.ndarray | None:
        """``of_bin(feature)`` has words per bin or is None; those of all the unit's features over its numbers."""
        words = None
        for j, feature in enumerate(self.units[unit]):
            here = of_bin(feature)
            if here is not None:
                here = here if unit < len(self.loose) else here[:, self.bins[:, j]]
                words = here if words is None else words & here
        return words


class Leaves:
    """Finds the leaf of many cells: every number of a group rules out leaves, as bits of one or more words."""

    def __init__(self, tree: Tree, layout: Layout):
        self.nodes = np.array(tree.leaves())
        place = {leaf: i for i, leaf in enumerate(self.nodes.tolist())}
        count = -(-len(place) // WORD)
        full = (1 << len(place)) - 1

        def split_up(mask: int) -> np.ndarray:
            return np.array([mask >> (WORD * w) & ((1 << WORD) - 1) for w in range(count)], np.uint64)[:, None]

        by_feature: dict[int, np.ndarray] = {}
        for node, feature in enumerate(tree.feature):
            if feature >= 0:
                left, right = (sum(1 << place[leaf] for leaf in tree.leaves(tree.left[node] + side)) for side in (0, 1))
                goes = tree.goes_left(node, np.arange(layout.sizes[feature]))
                kept = np.where(goes, split_up(full & ~right), split_up(full & ~left))
                by_feature[feature] = by_feature[feature] & kept if feature in by_feature else kept
        self.words: list[np.ndarray | None] = []
        for units in layout.joint:
            words, size = np.full((count, 1), np.uint64((1 << WORD) - 1)), 1
            for u in units:
                mine = layout.by_unit(u, by_feature.get)
                if mine is None:
                    mine = np.full((count, layout.unit_size(u)), np.uint64((1 << WORD) - 1))
                words = (mine[:, :, None] & words[:, None, :]).reshape(count, -1)
                size *= layout.unit_size(u)
            used = any(feature in by_feature for u in units for feature in layout.units[u])
            self.words.append(words if used else None)
        self.count = count

    def of(self, codes: list[np.ndarray]) -> np.ndarray | None:
        """The place of the leaf of every cell among ``nodes``; None if there is one leaf only."""
        out = None
        for w in range(self.count):
            left = None
            for words, code in zip(self.words, codes):
                if words is not None:
                    here = words[w][code]
                    left = here if left is None else np.bitwise_and(left, here, out=left)
            if left is None:
                return None
            at = np.bitwise_count(left - np.uint64(1))
            out = at if out is None else np.where(found, out, at.astype(np.int64) + WORD * w)
            found = left != 0 if w == 0 else found | (left != 0)
        return out


@dataclass(frozen=True)
class ResidualTrees:
    """``rounds`` trees of least squares.

    The gradient of a squared error is twice the residual, so a tree but the
    first moves the prediction by twice ``step`` of the mean residual of a leaf.
    """

    names: int
    nominal: dict[int, int]
    seasonal: tuple[int, ...] = ()
    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    bins: int = 64
    label: str = "label"
    weight: str = "weight"
    output: str = "prediction"
    partitions: int | None = None

    def fit(self, rows: DataFrame, calendar: tuple[list[int], list[list[float]]] | None = None) -> tuple[ResidualModel, int]:
        """Train on all rows of ``FittedVector.compact``, read once, and count them; ``calendar`` has the keys that days can have."""
        columns = [f"__x{i}" for i in range(self.names) if i not in self.seasonal]
        blocks = packed(rows, [*columns, DAY, self.label, self.weight]).persist()
        try:
            counted, label, weight = self._facts(blocks)
            n = sum(counted.values())
            whole, layout = self._layouts(blocks, n, counted, calendar)
            cells, near = self._cells(blocks, layout, n, label, weight)
        finally:
            blocks.unpersist()
        gains = np.zeros(self.names)
        held = rows.sparkSession.sparkContext.broadcast(layout)
        state = cells.rdd.map(partial(_unpacked, held=held))
        if near:
            trees, found = state.mapPartitions(partial(_grow_near, trainer=self, held=held)).first()
            gains += found
        else:
            trees = self._grow_far(state, held, gains)
        total = gains.sum()
        return ResidualModel(whole, trees, gains / total if total else gains, self.output), n

    def _facts(self, blocks: DataFrame) -> tuple[dict[int, int], float, float]:
        """How many rows each day has, and the largest label, whatever its sign, and weight."""
        names = [DAY, self.label, self.weight]

        def facts(batches):
            for block in _arrays(batches, names, DAY):
                day, label, weight = (block[c] for c in names)
                days, n = np.unique(day, return_counts=True)
                same = [pa.array(np.full(len(days), value)) for value in (np.abs(label).max(), weight.min(), weight.max())]
                yield pa.RecordBatch.from_arrays([pa.array(days), pa.array(n), *same], ["day", "n", "label", "least", "most"])

        found = blocks.select(*names).mapInArrow(facts, "day bigint, n bigint, label double, least double, most double")
        rows = found.groupBy("day").agg(F.sum("n").alias("n"), F.max("label").alias("label"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
        if not rows:
            raise ValueError("no rows to train on")
        values = np.array([(r["label"], r["least"], r["most"]) for r in rows])
        if not np.isfinite(values).all() or values[:, 1].min() < 0:
            raise ValueError("labels and weights must be finite, and weights not negative")
        return {r["day"]: r["n"] for r in rows}, float(values[:, 0].max()) or 1.0, float(values[:, 2].max()) or 1.0

    def _grow_far(self, cells: RDD, held: Broadcast[Layout], gains: np.ndarray) -> list[Tree]:
        """Trees from sums over all partitions, a job for each level."""
        state = cells.persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[Tree] = []
        older = written = None

        def splits(tree: Tree, active: list[int]) -> list[dict]:
            nonlocal older, written
            found = self._splits(state, held, tree, active)
            if older is not None:  # the first level has computed and, if asked for, written what follows it
                older.unpersist()
                older = None
                if state.isCheckpointed():
                    _delete(state, written)
                    written = state.getCheckpointFile()
            return found

        for number in range(self.rounds):
            trees.append(self.grow(splits, number, gains))
            if number + 1 < self.rounds:
                older = state
                state = older.mapPartitions(partial(_advance, tree=trees[-1], held=held)).persist(StorageLevel.MEMORY_AND_DISK)
                if (number + 1) % STORE_EVERY == 0:
                    state.checkpoint()
        state.unpersist()
        _delete(state, written)
        return trees

    def grow(self, splits: Callable[[Tree, list[int]], list[dict]], number: int, gains: np.ndarray) -> Tree:
        """One tree; ``splits`` gives the mean of every active node and the best split of those that have one."""
        tree, active, step = Tree(), [0], 2 * self.step if number else 1.0
        for level in range(max(1, self.depth)):
            found = splits(tree, active)
            if not level:
                tree.value[0] = step * sum(row["mean"] for row in found)
            active = []
            for row in sorted((r for r in found if "feature" in r and self.depth), key=lambda r: r["node"]):
                tree.split(row["node"], row["feature"], row["bound"], row["levels"], (step * row["left"], step * row["right"]))
                active += [len(tree.feature) - 2, len(tree.feature) - 1]
                gains[row["feature"]] += row["gain"] * (4 if number else 1)  # of gradients, which are twice the residuals
            if not active:
                break
        return tree

    def _layouts(self, blocks: DataFrame, n: int, counted: dict[int, int], calendar) -> tuple[Layout, Layout]:
        """Bins of all features: with all keys that there can be, and with those among the rows."""
        numbers = [i for i in range(self.names) if i not in self.nominal and i not in self.seasonal]
        ranks = [-(-k * n // self.bins) for k in range(1, self.bins)]
        bounds: list[tuple[float, ...] | None] = [None] * self.names
        for i, (least, *found) in zip(numbers, quantiles(blocks, [f"__x{i}" for i in numbers], [1, *ranks]) if numbers else []):
            bounds[i] = self._bounds(least, found)
        if not self.seasonal:
            whole = Layout(tuple(bounds), self._sizes(bounds))
            return whole, whole
        keys, terms = calendar
        terms = np.array([*terms, [0.0] * len(self.seasonal)])
        known = [*keys, NO_DAY]
        present = [k for k, key in enumerate(known) if key in counted]
        times = np.array([counted[known[k]] for k in present])
        for j, i in enumerate(self.seasonal):
            order = np.argsort(terms[present, j], kind="stable")
            values, below = terms[present, j][order], np.cumsum(times[order])
            distinct = np.unique(values)
            bounds[i] = tuple(distinct.tolist()) if len(distinct) <= self.bins else self._bounds(
                values[0], values[np.searchsorted(below, ranks)].tolist())
        bins = np.stack([np.searchsorted(bounds[i], terms[:, j], side="left") for j, i in enumerate(self.seasonal)], axis=1).astype(np.int32)
        sizes = self._sizes(bounds)
        mine = [k for k in present if k < len(keys)]
        return (Layout(tuple(bounds), sizes, self.seasonal, tuple(keys), bins),
                Layout(tuple(bounds), sizes, self.seasonal, tuple(keys[k] for k in mine), bins[[*mine, len(keys)]]))

    def _bounds(self, least: float, found: list[float]) -> tuple[float, ...]:
        """Upper bounds of bins; the smallest value has one of its own if there is room, as where most values are the same."""
        bounds = set(found)
        return tuple(sorted(bounds | {least} if len(bounds) < self.bins - 1 else bounds))

    def _sizes(self, bounds) -> tuple[int, ...]:
        return tuple(self.nominal[i] if b is None else len(b) + 1 for i, b in enumerate(bounds))

    def _cells(self, blocks: DataFrame, layout: Layout, n: int, most_label: float, most_weight: float) -> tuple[DataFrame, bool]:
        """Blocks of cells, dealt by a hash of their numbers and sorted, so that sums do not depend on files or the cluster.

        Says as well whether one task can hold all of them.
        """
        label, weight, columns = self.label, self.weight, [f"__x{i}" for i in layout.loose]
        width = sum(kind.itemsize for kind in layout.kinds) + 16
        unit = 2.0 ** (62 - n.bit_length())  # whole numbers of it add up to the same sum in any order; what is left over is added up apart

        def coded(batches):
            for block in _arrays(batches, [*columns, DAY, label, weight], DAY):
                mass = block[weight] / most_weight
                parts = []
                for values in (mass, mass * (block[label] / most_label)):
                    high = np.floor(values * unit)
                    parts += [high, np.floor((values * unit - high) * unit)]
                codes = layout.codes(lambda i: block[f"__x{i}"], lambda: block[DAY])
                yield pa.RecordBatch.from_arrays([_packed(codes), *(pa.array(part.astype(np.int64)) for part in parts)], ["cell", *sums])

        def together(batches):
            for held in _gathered(batches, BLOCK // width):
                table = pa.Table.from_batches(held)
                parts = [table[c].to_numpy().astype(float) for c in sums]
                weights, rests = ((high + low / unit) / unit * most_weight for high, low in (parts[:2], parts[2:]))
                found = [b"".join(table["cell"].to_pylist()), weights.tobytes(), (rests * most_label).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in found], ["cells", "weight", "rest"])

        sums = ["weight", "weight_low", "rest", "rest_low"]
        table = blocks.mapInArrow(coded, ", ".join(["cell binary", *(f"{c} bigint" for c in sums)]))
        summed = table.groupBy("cell").agg(*(F.sum(c).alias(c) for c in sums)).persist()
        size = summed.count() * width
        near = size <= NEAR
        partitions = 1 if near else max(self.partitions or LEAST_PARTITIONS, -(-size // PARTITION))
        dealt = summed.repartition(partitions, "cell").sortWithinPartitions("cell")
        stored = materialise(dealt.mapInArrow(together, "cells binary, weight binary, rest binary"))
        summed.unpersist()
        return stored, near

    def passes(self, active: list[int], layout: Layout) -> list[list[int]]:
        """Nodes whose sums a task can keep all at once."""
        most = max(1, SUMS_PER_PASS // (2 * sum(layout.joint_sizes)))
        return [active[first : first + most] for first in range(0, len(active), most)]

    def _splits(self, state: RDD, held: Broadcast[Layout], tree: Tree, active: list[int]) -> list[dict]:
        found: list[dict] = []
        best = partial(_best, held=held, nominal=frozenset(self.nominal))
        for nodes in self.passes(active, held.value):
            sums = state.mapPartitions(partial(_histograms, tree=tree, nodes=nodes, held=held))
            if state.getNumPartitions() * len(nodes) * held.value.unit_starts[-1] <= SUMS_ON_DRIVER:  # another stage would take longer
                by_node: dict[int, list] = {}
                for node, part in sums.collect():
                    by_node.setdefault(node, []).append(part)
                found += map(best, by_node.items())
            else:
                found += sums.groupByKey(min(len(nodes), state.getNumPartitions())).map(best).collect()
        return found


def _grow_near(blocks, trainer: ResidualTrees, held: Broadcast[Layout]):
    """All trees in one task, which holds all cells: so few, however many the rows, that a job for each level would take longer."""
    state, trees, gains = list(blocks), [], np.zeros(trainer.names)
    best = partial(_best, held=held, nominal=frozenset(trainer.nominal))

    def splits(tree: Tree, active: list[int]) -> list[dict]:
        return [best((node, [part])) for nodes in trainer.passes(active, held.value) for node, part in _histograms(state, tree, nodes, held)]

    for number in range(trainer.rounds):
        trees.append(trainer.grow(splits, number, gains))
        state = list(_advance(state, trees[-1], held))
    if state:
        yield trees, gains


def _packed(codes: list[np.ndarray]) -> pa.Array:
    """The numbers of each row as bytes."""
    rows = np.empty(len(codes[0]), _row_type([c.dtype for c in codes]))
    for name, code in zip(rows.dtype.names, codes):
        rows[name] = code
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _row_type(kinds: list[np.dtype]) -> np.dtype:
    return np.dtype([(f"c{i}", kind) for i, kind in enumerate(kinds)])


def _unpacked(row, held: Broadcast[Layout]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    cells = np.frombuffer(bytes(row["cells"]), _row_type(held.value.kinds))
    return [np.ascontiguousarray(cells[name]) for name in cells.dtype.names], np.frombuffer(bytes(row["weight"])), np.frombuffer(bytes(row["rest"]))


def _advance(blocks, tree: Tree, held: Broadcast[Layout]):
    """What a tree leaves over."""
    leaves = Leaves(tree, held.value)
    values = np.array(tree.value)[leaves.nodes]
    for codes, weight, rest in blocks:
        at = leaves.of(codes)
        yield codes, weight, rest - weight * (values[0] if at is None else values[at])


def _histograms(blocks, tree: Tree, nodes: list[int], held: Broadcast[Layout]):
    """For each node its sums of weights and of what is left over, unit by unit."""
    layout = held.value
    leaves, n = Leaves(tree, layout), len(nodes)
    slot = np.full(len(tree.feature), n)
    slot[nodes] = np.arange(n)
    slot = slot[leaves.nodes]
    sums = [np.zeros((2, (n + 1) * size)) for size in layout.joint_sizes]
    empty = True
    for codes, weight, rest in blocks:
        empty = False
        at = leaves.of(codes)
        at = None if at is None else slot[at]
        for code, size, mine in zip(codes, layout.joint_sizes, sums):
            place = code.astype(np.intp) if at is None else at * size + code
            for both, values in zip(mine, (weight, rest)):
                both += np.bincount(place, values, len(both))
    if empty:
        return
    by_unit = {}
    for group, (size, mine) in enumerate(zip(layout.joint_sizes, sums)):
        spread = layout.marginals(group, mine.reshape(2, n + 1, size)[:, :n].reshape(2 * n, size))
        by_unit |= {u: part.reshape(2, n, -1) for u, part in spread.items()}
    whole = np.concatenate([by_unit[u] for u in range(len(layout.units))], axis=2)
    for k, node in enumerate(nodes):
        yield node, (TaskContext.get().partitionId(), np.ascontiguousarray(whole[:, k]))


def _best(found, held: Broadcast[Layout], nominal: frozenset[int]) -> dict:
    """The mean of a node and its best split: numbers in order, categories by their means."""
    layout, (node, parts) = held.value, found
    sums = sum(part for _, part in sorted(parts, key=lambda p: p[0]))  # always in the same order
    starts = layout.unit_starts
    W, R = sums[:, : starts[1]].sum(axis=1)
    chosen = {"node": node, "mean": float(R / W) if W > 0 else 0.0, "gain": 0.0}
    numbers = [i for i in range(len(layout.sizes)) if i not in nominal]
    ordered = layout.ordered(sums, numbers) if numbers else np.zeros((2, 0, 1))
    candidates = [(numbers, ordered, None)]
    for u, (feature, *_) in enumerate(layout.units[: len(layout.loose)]):
        if feature in nominal:
            mine = sums[:, starts[u] : starts[u + 1]]
            order = np.flatnonzero(mine[0] > 0)
            order = order[np.lexsort((order, mine[1, order] / mine[0, order]))]
            candidates.append(([feature], mine[:, None, order], order))
    for features, mine, order in candidates:
        if not features or mine.shape[2] < 2:
            continue
        w, r = np.cumsum(mine, axis=2)
        v, s = w[:, -1:] - w, r[:, -1:] - r
        with np.errstate(divide="ignore", invalid="ignore"):
            sides, whole = r**2 / w + s**2 / v, (r[:, -1:]) ** 2 / w[:, -1:]
            gain = np.where((w > 0) & (v > 0) & (sides - whole > LEAST_GAIN * sides), sides - whole, 0.0)
        # Features that split alike differ by rounding: the first of them is taken.
        f, i = np.unravel_index(int((gain >= gain.max() * (1 - TIE)).argmax()), gain.shape)
        if gain[f, i] > chosen["gain"] * (1 + TIE):
            chosen |= {"feature": features[f], "bound": int(i if order is None else order[i]),
                       "levels": None if order is None else sorted(order[: i + 1].tolist()),
                       "gain": float(gain[f, i]), "left": float(r[f, i] / w[f, i]), "right": float(s[f, i] / v[f, i])}
    return chosen


def _delete(state: RDD, path: str | None) -> None:
    """Remove a checkpoint that a later one has replaced."""
    if path:
        at = state.ctx._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(state.ctx._jsc.hadoopConfiguration()).delete(at, True)


class ResidualModel:
    """Fitted trees, whose values add up to the prediction; ``transform`` reads the columns of ``FittedVector.compact``."""

    def __init__(self, layout: Layout, trees: list[Tree], importances: np.ndarray, output: str):
        self.layout, self.trees, self.output = layout, trees, output
        self.featureImportances = DenseVector(importances)

    @cached_property
    def _leaves(self) -> list[tuple[Leaves, np.ndarray]]:
        found = [Leaves(tree, self.layout) for tree in self.trees]
        return [(leaves, np.array(tree.value)[leaves.nodes]) for leaves, tree in zip(found, self.trees)]

    def scores(self, codes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(codes[0]))
        for leaves, values in self._leaves:
            at = leaves.of(codes)
            out += values[0] if at is None else values[at]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast((self.layout, self.trees, self.featureImportances.toArray(), self.output))
        place = {i: k for k, i in enumerate(self.layout.loose)}

        @F.arrow_udf("double")
        def predicted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            model = ResidualModel(*held.value)
            for columns in batches:
                codes = model.layout.codes(lambda i: columns[place[i]].to_numpy(zero_copy_only=False), lambda: columns[-1].fill_null(NO_DAY).to_numpy(zero_copy_only=False))
                yield pa.array(model.scores(codes))

        return df.withColumn(self.output, predicted(*(f"__x{i}" for i in self.layout.loose), DAY))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for the layout and one for each tree."""
        layout = self.layout
        head = {"bounds": layout.bounds, "sizes": layout.sizes, "seasonal": layout.seasonal, "keys": layout.keys,
                "bins": None if layout.bins is None else layout.bins.tolist(), "importances": self.featureImportances.toArray().tolist(),
                "output": self.output}
        rows = [{"round": -1, "part": json.dumps(head)}, *({"round": r, "part": json.dumps(vars(tree))} for r, tree in enumerate(self.trees))]
        local_frame(spark, rows, "round int, part string").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResidualModel:
        head, *parts = (json.loads(part) for _, part in sorted((r["round"], r["part"]) for r in spark.read.parquet(path).collect()))
        bounds = tuple(None if b is None else tuple(b) for b in head["bounds"])
        bins = None if head["bins"] is None else np.array(head["bins"], np.int32)
        layout = Layout(bounds, tuple(head["sizes"]), tuple(head["seasonal"]), tuple(head["keys"]), bins)
        return cls(layout, [Tree(**part) for part in parts], np.array(head["importances"]), head["output"])
