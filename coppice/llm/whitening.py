"""Embedding whitening with distributed block matrices.

Centred rows are numbered and indexed into blocks of a distributed matrix A;
the transpose times A is the scatter, whose eigenvectors are found on the
driver, and A times the whitening matrix W projects every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.textwork import pick
from coppice.operators.lookup import local_frame
from coppice.session import store_columns

#: Values of a block: at least, and at most. Between them blocks grow so that there are about ``MANY_BLOCKS``.
BLOCK_VALUES, LARGEST_BLOCK, MANY_BLOCKS = 1 << 18, 1 << 23, 1 << 18
#: Blocks whose products one task of a scatter adds up, once there are more than tasks.
BLOCKS_PER_TASK = 16
#: Scaled entries from here on are left out: their sums would not be exact.
LARGEST = float(1 << 46)
#: Eigenvalues up to this share of the largest are those of directions without spread.
FLAT = 1e-12
_PLACE_BITS = 33


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``sums`` per dimension over ``n`` rows, eigenvalues (falling) and unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def matrix(self) -> np.ndarray:
        """The whitening matrix: eigenvectors over the root of their eigenvalue; flat directions become zero."""
        flat = self.eigenvalues <= FLAT * max(self.eigenvalues.max(initial=0), 0)
        scale = np.where(flat, 0, 1 / np.sqrt(np.where(flat, 1, self.eigenvalues)))
        return self.components * scale


def integer_rows(vectors: DataFrame, scale: int, shift: int, id_column: str, vector_column: str) -> DataFrame:
    """``row`` (from 0), ``vec_id`` and ``x = floor(scale * entry) + shift`` of the rows that take part."""
    vector = F.col("vector")
    picked = pick(vectors, vec_id=id_column, vector=vector_column).withColumn("vector", vector.cast("array<double>"))
    unfit = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale >= LARGEST))
    good = picked.where(vector.isNotNull() & (F.size(vector) > 0) & ~unfit)
    widths = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.col("count").desc(), "width").take(1)
    width = widths[0]["width"] if widths else 0
    x = F.transform(vector, lambda c: F.floor(c * scale) + F.lit(shift).cast("long"))
    stored = store_columns(good.where(F.size(vector) == width).select(
        "vec_id", x.alias("x"), F.monotonically_increasing_id().alias("place")))
    # Rows are numbered by the place they were written at, so a repeated task finds the same numbers.
    part, within = F.shiftrightunsigned("place", _PLACE_BITS), F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    starts, total = [], 0
    for row in sorted(stored.groupBy(part.alias("part")).count().collect()):  # one row per task that wrote
        starts.append({"part": row["part"], "start": total})
        total += row["count"]
    offsets = F.broadcast(local_frame(vectors.sparkSession, starts, "part bigint, start bigint"))
    return stored.withColumn("part", part).join(offsets, "part").select((F.col("start") + within).alias("row"), "vec_id", "x")


@dataclass(frozen=True)
class Totals:
    """Row count, and per dimension the exact sum, the smallest and the largest entry."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]


def dimension_totals(rows: DataFrame) -> Totals:
    found = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(18,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    table = sorted(found.collect())  # one row per dimension
    return Totals(table[0]["n"], *([int(r[k]) for r in table] for k in ("s", "lo", "hi")))


def block_rows(n: int, width: int) -> int:
    """Rows of a block: few while there are few, more for many rows, within the bounds on a block's values."""
    least, most = max(1, BLOCK_VALUES // width), max(1, LARGEST_BLOCK // width)
    return min(max(least, -(-n // MANY_BLOCKS)), most)


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The distributed matrix of ``row`` and ``vector`` (array of doubles), blocks as wide as the matrix."""
    ready = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(ready, n, width).toBlockMatrix(block_rows(n, width), width)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, its inner dimension dealt to ``splits`` tasks.

    Without the last argument, which only the Scala method takes, one task
    gets every block of a small product.
    """
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, tasks: int) -> np.ndarray:
    """Transpose times matrix: width x width numbers, the sum of every block's share."""
    blocks = matrix.numRowBlocks
    splits = min(blocks, max(tasks, -(-blocks // BLOCKS_PER_TASK)))
    return _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _centred(column: str, centre: np.ndarray) -> Column:
    return F.zip_with(column, F.lit(centre.tolist()), lambda a, b: a - b)


def fit_and_project(rows: DataFrame, totals: Totals, components: int) -> tuple[Whitening, DataFrame, float | None]:
    """Fit on all ``rows`` (``row`` from 0 without gaps, ``x``) and project them: the fit, ``row`` with ``whitened``, and the identity error."""
    n, sums = totals.n, totals.sums
    width, tasks = len(sums), rows.sparkSession.sparkContext.defaultParallelism
    mean = np.array([s / n for s in sums])
    matrix = block_matrix(rows.select("row", _centred("x", mean).alias("vector")), n, width)
    covariance = scatter(matrix, tasks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    falling = np.argsort(-values, kind="stable")
    fitted = Whitening(n, tuple(sums), values[falling], vectors[:, falling])

    kept = min(components, width)
    weights = fitted.matrix()[:, :kept]
    spark = rows.sparkSession.sparkContext
    factor = BlockMatrix(spark.parallelize([((0, 0), DenseMatrix(width, kept, weights.ravel("F")))], 1), width, kept, width, kept)
    product = _times(matrix, factor, 1).toIndexedRowMatrix()
    projected = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model), "vector")
    projected = store_columns(projected.select(F.col("index").alias("row"), vector_to_array("vector").alias("whitened")))

    middle = projected.select([F.avg(F.col("whitened")[i]).alias(str(i)) for i in range(kept)]).first()
    again = block_matrix(projected.select("row", _centred("whitened", np.array(middle)).alias("vector")), n, kept)
    sloped = np.flatnonzero(weights.any(axis=0))
    off = (scatter(again, tasks) / n)[np.ix_(sloped, sloped)] - np.eye(len(sloped))
    return fitted, projected, float(np.abs(off).max()) if len(sloped) else None


def deviations(totals: Totals) -> Column:
    """The exact sum over dimensions of (n x - S)^2 of each row, as decimal(38,0); null beyond its range.

    With S = n q + r and a = x - q it is n^2 sum(a^2) - 2 n sum(a r) + sum(r^2),
    so only three numbers of a row are wide. Sums that could pass 63 bits are
    added up as decimals.
    """
    n, sums, low, high = totals.n, totals.sums, totals.low, totals.high
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    largest = max(max(abs(h - q), abs(lo - q)) for h, lo, q in zip(high, low, whole))
    kind = "bigint" if len(sums) * largest * max(largest, n) < 2**62 else "decimal(38,0)"
    away = F.zip_with("x", F.lit(whole), lambda x, q: x - q)

    def total(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0).cast(kind), lambda t, a: F.try_add(t, a).cast(kind)).cast("decimal(38,0)")

    squares = total(F.transform(away, lambda a: (a.cast(kind) * a.cast(kind)).cast(kind)))
    mixed = total(F.zip_with(away, F.lit(rest), lambda a, r: (a.cast(kind) * r.cast(kind)).cast(kind)))
    fixed = F.lit(sum(r * r for r in rest)).cast("decimal(38,0)")
    count = F.lit(n).cast("decimal(20,0)")

    def times(a: Column, b: Column) -> Column:
        return F.try_multiply(a, b).cast("decimal(38,0)")

    inner = F.try_subtract(times(squares, count), times(mixed, F.lit(2).cast("decimal(20,0)"))).cast("decimal(38,0)")
    return F.try_add(times(inner, count), fixed).cast("decimal(38,0)")


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """Whitened coordinates of every row, and how far it lies from the mean.

    Entries become ``x = floor(scale * entry) + shift``; the fit is over all
    rows that take part, with divisor n, centred before multiplying. Returns,
    per row and component up to ``components`` (or the number of dimensions):
    ``vec_id``, ``component`` from 1 by falling eigenvalue, ``n``,
    ``deviation`` (exact sum over dimensions of (n x - S)^2, decimal; null
    beyond 38 digits), ``whitened`` ((x - S/n) on the unit eigenvector, over
    the root of its eigenvalue), ``explained`` (share of the eigenvalue in the
    total variance) and ``identity_error`` (largest entry of whitened's
    covariance minus the identity, one value for all rows).

    Null and empty vectors, vectors with null or non-finite entries or entries
    of 2^46 or more after scaling, and vectors of another length than the most
    frequent one (the shorter, on a tie) take no part. Repeated rows and null
    ids are rows like any other. A direction without spread has ``whitened``
    null and stands outside ``identity_error``, which is null if there is no
    other; ``explained`` is null if nothing has spread. Other columns are not
    read; no rows give no rows.

    The driver holds matrices of width x width, one row per dimension and per
    task, and the coordinates of the blocks (at most about 2^18 until blocks
    have 2^23 values).
    """
    rows = integer_rows(vectors, scale, shift, id_column, vector_column)
    if rows.isEmpty():
        kinds = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double",
                 "identity_error": "double"}
        return rows.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()))
    totals = dimension_totals(rows)
    fitted, projected, error = fit_and_project(rows, totals, components)
    kept = min(components, len(fitted.sums))
    trace = float(np.clip(fitted.eigenvalues, 0, None).sum())
    shares = [float(max(e, 0) / trace) if trace > 0 else None for e in fitted.eigenvalues[:kept]]
    flat = ~fitted.matrix()[:, :kept].any(axis=0)
    facts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(s).cast("double").alias("explained"), F.lit(bool(f)).alias("flat"))
                      for i, (s, f) in enumerate(zip(shares, flat))])
    told = rows.select("row", "vec_id", deviations(totals).alias("deviation")).join(projected, "row")
    parts = F.explode(F.arrays_zip(facts.alias("fact"), F.col("whitened").alias("whitened"))).alias("part")
    value = F.when(~F.col("part.fact.flat"), F.col("part.whitened"))
    return told.select("vec_id", "deviation", parts).select(
        "vec_id", F.col("part.fact.component").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        value.alias("whitened"), F.col("part.fact.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
