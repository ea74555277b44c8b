"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import store_columns

#: Links up to which one task unites them; more are united by rounds of shuffles.
FEW_LINKS = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of ``edges`` (``a``, ``b``).

    Each round hangs a node's neighbours on the smallest node among them. Links
    are joined with one row per node, so a node with very many links may be
    split over tasks. Rounds grow with the logarithm of the longest chain.
    At most ``FEW_LINKS`` links, a bound whatever the input, are united by one task.
    """
    stars = store_columns(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    if stars.count() <= FEW_LINKS:
        kind = stars.schema["a"].dataType.simpleString()
        return store_columns(stars.coalesce(1).mapInArrow(_unite, f"node {kind}, root {kind}"))
    while True:
        # Large stars: larger neighbours move to the smallest neighbour.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = store_columns(large.distinct())
        # Small stars: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(
            joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        small = store_columns(small.distinct())
        if stars.count() == small.count() and stars.join(small, ["a", "b"], "left_anti").isEmpty():
            break
        stars = small
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _unite(batches):
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(root), kind), "root": pa.array([find(x) for x in root], kind)})
