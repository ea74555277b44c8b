"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is rotated by sign flips and fast Hadamard transforms; its hash
is the signed axis nearest to it. Each of several tables is probed at the
query's nearest axes, and the candidates are ranked by exact inner product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.textwork import map_batches, pick
from coppice.session import store_columns

#: Rows that one task compares at once, of candidates and of queries: a bound on its memory.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass(frozen=True)
class SearchParams:
    """``tables`` hash tables, each probed at ``probes`` axes of the query; a candidate stands under 1 to ``places`` axes."""

    k: int = 20
    tables: int = 8
    probes: int = 12
    seed: int = 7
    places: int = 16


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two."""
    rows = rows.copy()
    n, width, h = *rows.shape, 1
    while h < width:
        pairs = rows.reshape(n, width // (2 * h), 2, h)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1]
        pairs[:, :, 0] += b
        pairs[:, :, 1] = a - b
        h *= 2
    return rows


def rotated(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, padded to a power of two."""
    width = 1 << max(unit.shape[1] - 1, 1).bit_length()
    rows = np.zeros((len(unit), width))
    rows[:, : unit.shape[1]] = unit
    random = np.random.default_rng([seed, table])
    for _ in range(3):
        rows = hadamard(rows * random.choice([-1.0, 1.0], width)) / np.sqrt(width)
    return rows


def axes(rotation: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row: 2 i for +i, 2 i + 1 for -i."""
    both = np.stack([rotation, -rotation], axis=2).reshape(len(rotation), -1)
    count = min(count, both.shape[1])
    top = np.argpartition(-both, count - 1, axis=1)[:, :count]
    return top


def nearest_first(rotation: np.ndarray, count: int) -> np.ndarray:
    """Those of :func:`axes` by distance."""
    found = axes(rotation, count)
    along = np.take_along_axis(rotation, found // 2, axis=1) * (1 - 2 * (found % 2))
    return np.take_along_axis(found, np.argsort(-along, axis=1, kind="stable"), axis=1)


def _blobs(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(vectors, "<f8")], pa.binary())


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has only finite components, not all of them zero."""
    vector = F.col("vector")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))


def typical_norm(rows: DataFrame) -> float:
    """The median length of the vectors, nearly; 0 if there are none."""
    square = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda total, x: total + x * x)
    return rows.agg(F.percentile_approx(F.sqrt(square), 0.5, 10_000)).first()[0] or 0.0


def places_of(norms: np.ndarray, typical: float, most: int) -> np.ndarray:
    """Axes that a candidate stands under: the square of its length over the typical one.

    A long vector can have a large inner product with queries of quite other
    directions, so it must be met from farther away.
    """
    if not 0 < typical < np.inf:
        return np.ones(len(norms), np.int64)
    ratio = np.minimum(norms / typical, most)
    return np.clip(np.floor(ratio * ratio + 1e-5), 1, most).astype(np.int64)


def _hashed(rows: DataFrame, params: SearchParams, typical: float | None = None) -> DataFrame:
    """One row per vector and bucket: ``bucket``, ``vec_id`` and the vector as bytes.

    Queries stand under all axes that they probe, candidates, for which the
    ``typical`` length is given, under as many as their length asks for.
    """

    def work(batch):
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for size in np.unique(sizes):  # vectors of different length are never compared
            at = np.flatnonzero(sizes == size)
            raw = np.stack([flat[starts[i] : starts[i + 1]] for i in at])
            scale = np.abs(raw).max(axis=1, keepdims=True)  # keeps the norm within range
            unit = raw / scale
            norm = np.linalg.norm(unit, axis=1, keepdims=True)
            unit /= norm
            blobs, ids = _blobs(raw), batch.column(0).take(pa.array(at))
            if typical is None:
                count = np.full(len(raw), params.probes)
            else:
                with np.errstate(over="ignore"):
                    count = places_of((scale * norm)[:, 0], typical, params.places)
            for t in range(params.tables):
                near = nearest_first(rotated(unit, t, params.seed), int(count.max()))
                for p in range(near.shape[1]):
                    here = np.flatnonzero(count > p)
                    bucket = (np.int64(size) << 32) + (t << 20) + near[here, p]
                    chosen = pa.array(here)
                    yield {"bucket": pa.array(bucket, pa.int64()), "vec_id": ids.take(chosen), "blob": blobs.take(chosen)}

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_batches(rows.select("vec_id", F.col("vector").cast("array<double>")), work,
                       f"bucket long, vec_id {kind}, blob binary")


def _best_of(k: int):
    """Rank the candidates of one cell: exact inner products, the ``k`` best ids of each query."""

    def rank(key, table):
        is_query = np.asarray(table["is_query"])
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        blob = table["blob"].to_pylist()
        q, c = order[is_query[order]], order[~is_query[order]]
        rows: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(c):
            candidates, own = np.stack([np.frombuffer(blob[i], "<f8") for i in c]), ids[c]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # rows of an id stand together
            own = own[first]
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                score = np.stack([np.frombuffer(blob[i], "<f8") for i in part]) @ candidates.T
                for i, s in zip(part, np.maximum.reduceat(score, first, axis=1)):
                    s = np.where(own == ids[i], -np.inf, s)
                    if len(s) > k:  # ties at the end stay, so that the smaller id can win
                        top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        top = top[np.argsort(-s[top], kind="stable")[: k]]
                    else:
                        top = np.arange(len(s))
                    top = top[own[top] != ids[i]]
                    rows.append((np.full(len(top), ids[i]), own[top], s[top]))
        merged = [np.concatenate(x) for x in zip(*rows)] if rows else [ids[:0], ids[:0], np.zeros(0)]
        return pa.table({"query_id": pa.array(merged[0]).cast(table["vec_id"].type),
                         "vec_id": pa.array(merged[1]).cast(table["vec_id"].type),
                         "score": pa.array(merged[2], pa.float64())})

    return rank


def _cells(queries: DataFrame, candidates: DataFrame, k: int, sizes: DataFrame) -> DataFrame:
    """Compare queries and candidates of a bucket in cells of bounded size.

    ``sizes`` has for each bucket the numbers of blocks its queries and
    candidates are dealt to; a block of queries meets every block of candidates.
    """
    kind = candidates.schema["vec_id"].dataType.simpleString()
    place = F.xxhash64("vec_id")
    q = queries.join(sizes, "bucket").select(
        "bucket", F.pmod(place, "q_blocks").alias("q"),
        F.explode(F.sequence(F.lit(0), F.col("c_blocks").cast("int") - 1)).alias("c"), "vec_id", "blob",
        F.lit(True).alias("is_query"))
    c = candidates.join(sizes, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("q_blocks").cast("int") - 1)).alias("q"),
        F.pmod(place, "c_blocks").alias("c"), "vec_id", "blob", F.lit(False).alias("is_query"))
    both = q.withColumn("q", F.col("q").cast("int")).unionByName(c.withColumn("c", F.col("c").cast("int")))
    return both.groupBy("bucket", "q", "c").applyInArrow(_best_of(k), f"query_id {kind}, vec_id {kind}, score double")


def _blocks_of(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks of each bucket that has both queries and candidates."""
    counted = queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("n", "q_n").join(
        candidates.groupBy("bucket").agg(F.count(F.lit(1)).alias("c_n")), "bucket")
    return counted.select("bucket", F.ceil(F.col("q_n") / QUERY_BLOCK).alias("q_blocks"),
                          F.ceil(F.col("c_n") / CANDIDATE_BLOCK).alias("c_blocks"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; a pair found in several tables counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))), 1, k)
    # A query has at most k rows of each cell, so the list is bounded by tables, probes and blocks.
    ranked = once.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"),
                         F.col("x.score").alias("score"))


def nearest(vectors: DataFrame, is_query, params: SearchParams | None = None, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """The ``k`` candidates with the largest inner product for every query row.

    ``is_query`` is a condition on ``vec_id``; all other rows, and the queries
    except a row's own id, are candidates. Every vector stands in every table
    under its nearest axis, and under more the longer it is against the median
    of all, so that recall holds for vectors of unequal length too. Queries that meet fewer than ``k`` candidates are
    compared with all rows, in blocks. Returns ``query_id``, ``rank`` from 1,
    ``vec_id`` and ``score`` (inner product of the vectors as given, in double
    precision); equal scores go to the smaller id.

    Rows with a null id, and null, empty or
    zero vectors or such with null or non-finite components take no part;
    vectors of another length are no candidates. Repeated ids count once, with
    their best score. Other columns are not read; no rows give no rows.
    """
    params = params or SearchParams()
    rows = usable(pick(vectors, vec_id=id_column, vector=vector_column))
    queries = store_columns(_hashed(rows.where(is_query), params))
    candidates = store_columns(_hashed(rows, params, typical_norm(rows)))
    found = store_columns(_ranked(_cells(queries, candidates, params.k, _blocks_of(queries, candidates)), params.k))
    full = found.where(F.col("rank") == params.k).select("query_id")
    # What is left has fewer than k candidates: it meets one table's buckets as a whole, which are all rows.
    one_table = F.shiftrightunsigned(F.col("bucket"), 20) % 4096 == 0
    whole = F.shiftrightunsigned(F.col("bucket"), 32)
    short = queries.where(one_table).join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
    short = short.withColumn("bucket", whole).dropDuplicates(["bucket", "vec_id", "blob"])
    if short.isEmpty():
        return found
    everyone = candidates.where(one_table).withColumn("bucket", whole)
    rest = _ranked(_cells(short, everyone, params.k, _blocks_of(short, everyone)), params.k)
    kept = found.join(full, "query_id", "left_semi")
    return kept.unionByName(rest)
