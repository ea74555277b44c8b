"""Hard negatives by anchor spanning trees.

Anchors are dealt to groups of similar direction; each group has a minimum
spanning tree of Euclidean distances. For a candidate v, the score at an anchor
lies within edge length x |v| of the score at its parent in the tree. Only
candidates whose interval meets the anchor's window are scored again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.cross_polytope import axes, rotated
from coppice.llm.textwork import map_batches, pick
from coppice.operators.lookup import number_rows
from coppice.session import store_columns

#: Anchors of one tree and candidates of one block: a task's memory is a few times their product.
TREE_ANCHORS, CANDIDATE_BLOCK = 512, 8192
#: Share of a level's pairs above which all of them are scored by one product. It chooses the way, not the result.
DENSE = 0.2
#: Components from here on are left out, so that an inner product of 1024 of them fits in 63 bits.
LARGEST = float(1 << 26)


@dataclass(frozen=True)
class MiningParams:
    """Windows are ``low * positive <= 100 * negative <= high * positive``, in integers."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256


def prepared(rows: DataFrame, params: MiningParams) -> DataFrame:
    """``vec_id``, ``label``, ``width`` and the integer vector as little-endian 64-bit ``blob``, of rows that take part."""
    vector = F.col("vector")
    scaled = F.transform(vector, lambda c: F.floor(c * params.scale))
    unfit = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * params.scale >= LARGEST))
    good = rows.select("vec_id", "label", vector.cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~unfit)

    def work(batch):
        offsets = batch.column(2).offsets.to_numpy()
        data = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        first = 8 * (offsets - offsets[0])
        yield {"vec_id": batch.column(0), "label": batch.column(1), "width": pa.array(np.diff(offsets).astype(np.int32)),
               "blob": pa.array([data[a:b] for a, b in zip(first, first[1:])], pa.binary())}

    kinds = ", ".join(f"{n} {good.schema[n].dataType.simpleString()}" for n in ("vec_id", "label"))
    return map_batches(good.select("vec_id", "label", scaled.alias("x")), work, f"{kinds}, width int, blob binary")


def _matrix(blobs: pa.Array) -> np.ndarray:
    """Vectors of one width as rows."""
    parts = blobs.to_pylist()
    return np.frombuffer(b"".join(parts), "<i8").reshape(len(parts), -1)


def _directions(anchors: DataFrame, seed: int) -> DataFrame:
    """Anchors with the signed axis nearest to them after a random rotation, by which similar ones are sorted together."""
    def work(batch):
        widths, axis = batch.column("width").to_numpy(), np.zeros(batch.num_rows, np.int32)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            axis[at] = axes(rotated(_matrix(batch.column("blob").take(pa.array(at))).astype(float), 0, seed), 1)[:, 0]
        yield {**{n: batch.column(n) for n in batch.schema.names}, "axis": pa.array(axis)}

    return map_batches(anchors, work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema) + ", axis int")


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (parents first), parent position in that order (-1 for the root) and edge length, by Prim's rule."""
    n = len(points)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    order, place, edges = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    outside, at = np.ones(n, bool), 0
    for k in range(n):
        order[k], place[at], edges[k] = at, k, 0.0 if k == 0 else np.sqrt(near[at])
        outside[at] = False
        away = points - points[at]
        squared = np.einsum("ij,ij->i", away, away)
        closer = outside & (squared < near)
        near[closer], parent[closer] = squared[closer], at
        if k + 1 < n:
            at = int(np.where(outside, near, np.inf).argmin())
    parents = np.where(parent[order] >= 0, place[parent[order]], -1)
    return order, parents, edges


def plant_trees(anchors: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Number the anchors within ``keys`` in order of direction, and build one tree for each ``size`` of them.

    Adds ``tree`` (from 0 within ``keys``), ``place`` in the tree (parents
    first), ``parent`` (a place) and ``edge``; ``anchors`` has one row per anchor.
    """
    numbered, _ = number_rows(anchors, [*keys, "axis", "vec_id", "label", "blob"], "row")
    first = numbered.groupBy(*keys).agg(F.min("row").alias("first"))
    dealt = numbered.join(first, keys).select(
        *anchors.columns, F.floor((F.col("row") - F.col("first")) / size).cast("int").alias("tree"))

    def build(table):
        order, parents, edges = spanning_tree(_matrix(table["blob"].combine_chunks()).astype(float))
        table = table.take(pa.array(order))
        for name, values in (("place", np.arange(len(order))), ("parent", parents)):
            table = table.append_column(name, pa.array(values, pa.int32()))
        return table.append_column("edge", pa.array(edges))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return store_columns(dealt.groupBy("tree", *keys).applyInArrow(build, f"{kinds}, place int, parent int, edge double"))


class Scores:
    """Integer inner products of anchors (rows) and candidates, as exact 64-bit numbers."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        largest = float(np.abs(anchors).max()) * float(np.abs(candidates).max()) * anchors.shape[1]
        self.kind = np.float64 if largest < 2.0**53 else np.int64  # in doubles while those are exact
        self.anchors, self.candidates = anchors.astype(self.kind), candidates.astype(self.kind)
        self.norms = np.linalg.norm(candidates.astype(float), axis=1)
        self.scored = 0

    def level(self, members: np.ndarray, need: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Replace the bounds of the needed pairs by their scores."""
        if need.mean() > DENSE:
            low[:] = high[:] = self.anchors[members] @ self.candidates.T
            self.scored += need.size
            return
        for k, a in enumerate(members):
            at = np.flatnonzero(need[k])
            low[k, at] = high[k, at] = self.candidates[at] @ self.anchors[a]
            self.scored += len(at)

    def walk(self, parents: np.ndarray, edges: np.ndarray, needed):
        """From the root on, level by level: ``needed(members, low, high)`` says which pairs of a level must be scored.

        Yields the members of each level with their lower and upper bounds,
        which are equal where a pair was scored.
        """
        members = np.flatnonzero(parents < 0)
        low = high = np.zeros((len(members), len(self.candidates)))
        at = np.arange(len(members))
        children: dict[int, list[int]] = {}
        for i, p in enumerate(parents.tolist()):
            children.setdefault(p, []).append(i)
        root = True
        while len(members):
            # The last term covers the rounding of the bounds themselves.
            reach = edges[members, None] * self.norms * (1 + 1e-9) + 1e-9 * np.abs(high[at]) + 1
            low, high = low[at] - reach, high[at] + reach
            need = np.ones(low.shape, bool) if root else needed(members, low, high)
            self.level(members, need, low, high)
            yield members, low, high
            below = [(k, c) for k, m in enumerate(members.tolist()) for c in children.get(m, ())]
            at, members = np.array([k for k, _ in below], np.int64), np.array([c for _, c in below], np.int64)
            root = False


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Anchors in tree order and distinct candidates by id."""
    is_anchor = table["is_anchor"].to_numpy(zero_copy_only=False)
    anchors = table.filter(pa.array(is_anchor)).sort_by("place").combine_chunks()
    others = table.filter(pa.array(~is_anchor)).sort_by([("vec_id", "ascending"), ("label", "ascending"), ("blob", "ascending")]).combine_chunks()
    rows = list(zip(*(others[c].to_pylist() for c in ("vec_id", "label", "blob"))))
    fresh = [i for i, r in enumerate(rows) if i == 0 or r != rows[i - 1]]
    return anchors, others.take(pa.array(fresh, pa.int64()))


def _codes(values: pa.ChunkedArray, others: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of two columns."""
    both = pa.chunked_array([*values.chunks, *others.chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    return both[: len(values)], both[len(values) :]


def _best_positives(count: int):
    """In one cell: the best candidates of the anchors' label, by falling score, then id."""
    def rank(table: pa.Table) -> pa.Table:
        anchors, others = _split(table)
        rows: list[tuple] = []
        if anchors.num_rows and others.num_rows:
            same_a, same_c = _codes(anchors["vec_id"], others["vec_id"])
            scores = Scores(_matrix(anchors["blob"].combine_chunks()), _matrix(others["blob"].combine_chunks()))

            def needed(members, low, high):
                """Whether a pair can be among the best: ``count`` lower bounds of other ids above it rule it out."""
                if low.shape[1] <= count:
                    return np.ones(low.shape, bool)
                others_low = np.where(same_c == same_a[members, None], -np.inf, low)
                return high >= np.partition(others_low, low.shape[1] - count, axis=1)[:, low.shape[1] - count, None]

            for members, low, high in scores.walk(anchors["parent"].to_numpy(), anchors["edge"].to_numpy(), needed):
                for k, a in enumerate(members.tolist()):
                    exact = np.flatnonzero((low[k] == high[k]) & (same_c != same_a[a]))
                    s = high[k, exact]
                    if len(s) > count:
                        exact = exact[s >= np.partition(s, len(s) - count)[len(s) - count]]
                    best = exact[np.argsort(-high[k, exact], kind="stable")[:count]]
                    rows.append((np.full(len(best), a), best, high[k, best].astype(np.int64)))
        return _pairs(rows, anchors, others, {})

    return rank


def _window_negatives(count: int, params: MiningParams):
    """In one cell: for every anchor and positive score, the best candidates of other labels within the window."""
    def rank(table: pa.Table) -> pa.Table:
        anchors, others = _split(table)
        rows: list[tuple] = []
        if anchors.num_rows and others.num_rows:
            label_a, label_c = _codes(anchors["label"], others["label"])
            same_a, same_c = _codes(anchors["vec_id"], others["vec_id"])
            wanted = [[window(s, params) for s in p] for p in anchors["positives"].to_pylist()]
            hull = np.array([(min(lo for lo, _ in w), max(hi for _, hi in w)) for w in wanted], float)
            scores = Scores(_matrix(anchors["blob"].combine_chunks()), _matrix(others["blob"].combine_chunks()))

            def needed(members, low, high):
                return (high >= hull[members, :1]) & (low <= hull[members, 1:]) & (label_c != label_a[members, None])

            for members, low, high in scores.walk(anchors["parent"].to_numpy(), anchors["edge"].to_numpy(), needed):
                for k, a in enumerate(members.tolist()):
                    inside = (low[k] == high[k]) & (high[k] >= hull[a, 0]) & (high[k] <= hull[a, 1])
                    at = np.flatnonzero(inside & (label_c != label_a[a]) & (same_c != same_a[a]))
                    at = at[np.argsort(-high[k, at], kind="stable")]
                    falling = high[k, at].astype(np.int64)
                    for number, (lo, hi) in enumerate(wanted[a]):
                        start, end = np.searchsorted(-falling, [-hi, -lo + 1])
                        best = slice(start, min(start + count, max(end, start)))
                        rows.append((np.full(len(at[best]), a), at[best], falling[best], np.full(len(at[best]), number + 1)))
        return _pairs(rows, anchors, others, {"positive_rank": pa.int32()})

    return rank


def window(positive: int, params: MiningParams) -> tuple[int, int]:
    """Smallest and largest integer score of a negative; empty if the first is above the second."""
    return -(-params.low * positive // 100), params.high * positive // 100


def _pairs(rows: list[tuple], anchors: pa.Table, others: pa.Table, more: dict) -> pa.Table:
    merged = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * (3 + len(more))
    a, c = pa.array(merged[0], pa.int64()), pa.array(merged[1], pa.int64())
    columns = {"anchor": anchors["anchor"].take(a), "anchor_id": anchors["vec_id"].take(a), "vec_id": others["vec_id"].take(c),
               "score": pa.array(merged[2], pa.int64())}
    return pa.table(columns | {n: pa.array(v, t) for (n, t), v in zip(more.items(), merged[3:])})


def _cells(trees: DataFrame, candidates: DataFrame, keys: list[str], rank, schema: str) -> DataFrame:
    """Let every tree meet every block of the candidates with the same ``keys``; both are stored.

    Candidates are dealt to blocks by a hash of their id, as many as each key
    needs, so that neither a frequent label nor a large table makes a cell grow.
    """
    sizes = candidates.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).cast("int").alias("blocks")).join(
        trees.groupBy(*keys).agg((F.max("tree") + 1).alias("trees")), keys)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in trees.dtypes if n not in candidates.columns and n != "tree"]
    right = candidates.join(sizes, keys).select(
        *candidates.columns, F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"),
        F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(False).alias("is_anchor"), *nothing)
    left = trees.join(sizes, keys).select(
        *trees.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_anchor"))
    return left.unionByName(right).groupBy("tree", "block", *keys).applyInArrow(rank, schema)


def _first(pairs: DataFrame, by: list[str], count: int, rank: str) -> DataFrame:
    """The first ``count`` of each group by falling score, then id; Spark cuts each task's part before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= count)


def mine(vectors: DataFrame, is_anchor: Column, params: MiningParams | None = None, label: Column | None = None,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", seed: int = 7) -> DataFrame:
    """The hardest allowed negatives of every anchor and each of its positives.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` may replace the label
    by an expression of ``vec_id`` and ``label``. Components become
    ``floor(scale * x)``; a score is the inner product of such vectors. An
    anchor's positives are its ``positives`` best other rows of the same label,
    its negatives for one of them the ``negatives`` best rows of other labels
    inside the window of :class:`MiningParams`. Returns ``anchor_id``,
    ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score`` and
    ``negative_score``. Higher scores come first, then smaller ids.

    Results are exact: the bounds leave out only what cannot be returned.
    Rows with a null id or label, a null or empty vector, or a null or
    non-finite component take no part, nor do components of 2^26 or more after
    scaling. Vectors meet those of their own length. Copies of a row (id,
    label and vector) count once; rows of one id that differ are candidates
    each, anchors each, and never partners of their own id. A window below
    zero or without rows gives nothing. Other columns are not read; no rows
    give no rows.

    Trees of up to 512 anchors meet blocks of about 8192 candidates, each pair
    of them in a task of its own, so every candidate is sent once per tree.
    That work grows with the product of both numbers; the bounds save scoring,
    not sending, and save little where anchors are about as far apart as they
    are long.
    """
    params = params or MiningParams()
    picked = pick(vectors, vec_id=id_column, label=label_column, vector=vector_column)
    if label is not None:
        picked = picked.withColumn("label", label)
    rows = store_columns(prepared(picked, params))
    # Copies of an anchor are equal in all columns, which are short enough to be a key for these rows.
    own = rows.where(is_anchor).dropDuplicates().withColumn("anchor", F.sha2(F.concat_ws(
        "/", F.col("label").cast("string"), F.hex("blob")), 256)).withColumn("anchor", F.concat_ws("/", F.col("vec_id").cast("string"), "anchor"))
    anchors = store_columns(_directions(own, seed))
    kind = rows.schema["vec_id"].dataType.simpleString()
    found = f"anchor string, anchor_id {kind}, vec_id {kind}, score long"

    trees = plant_trees(anchors, ["width", "label"], TREE_ANCHORS)
    positives = store_columns(_first(
        _cells(trees, rows, ["width", "label"], _best_positives(params.positives), found),
        ["anchor"], params.positives, "positive_rank"))
    # At most as many as there are positives of one anchor.
    listed = positives.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "score"))),
                                                         lambda x: x["score"]).alias("positives"))
    trees = plant_trees(anchors.join(listed, "anchor"), ["width"], TREE_ANCHORS)
    negatives = _cells(trees, rows, ["width"], _window_negatives(params.negatives, params), f"{found}, positive_rank int")
    best = _first(negatives, ["anchor", "positive_rank"], params.negatives, "rank")
    return best.join(positives.select("anchor", "positive_rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                     ["anchor", "positive_rank"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
