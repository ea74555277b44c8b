"""Profiles, duplicates and correlations.

Correlations with categories never build indicator columns per row. With
``p`` the share of a level and ``y`` a number, the correlation of the level's
0/1 indicator with ``y`` is ``mean((y - ymean) * indicator) / sqrt(var(y) p (1-p))``;
for two levels it is the phi coefficient of their joint count. So counts and
sums per level are enough, and those are aggregated map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    DecimalType,
    FractionalType,
    LongType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from coppice.functions import columns as X
from coppice.functions.schema import CATEGORICAL, NUMERIC, columns_of, distinct_names, quote, require, tag_name
from coppice.operators.lookup import (
    SALT,
    WEIGHT,
    KeyedTable,
    attach,
    count_levels,
    freeze,
    grouping_set_id,
    local_frame,
    number_rows,
)
from coppice.session import materialise

# Numbers that one pass correlates with each other by a matrix of this width; wider tables take several passes.
MATRIX_WIDTH = 1000
# Levels of one side that a task pairs with as many of another.
LEVEL_BLOCK = 512
# Repeated digests of 16 bytes that are broadcast at most.
MANY_DIGESTS = 1 << 20


def min_value(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(X.col(column)).alias("min"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def distinct_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The combinations of group values that occur, in order."""
    return df.select(*columns).distinct().orderBy(*columns)


def profile(df: DataFrame) -> DataFrame:
    """One row per numeric or text column, from a single pass.

    Minimum and maximum come in a numeric and a text column each.
    """
    numeric, text = columns_of(df, NUMERIC), columns_of(df, CATEGORICAL)
    described = [c for c in df.columns if c in numeric or c in text]
    aggregates, rows = [], []
    for i, c in enumerate(described):
        aggregates += [F.count(c).alias(f"count{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
        if c in numeric:
            aggregates += [
                F.avg(c).cast("double").alias(f"mean{i}"),
                F.when(F.count(c) > 1, F.stddev_samp(c)).alias(f"std{i}"),
            ]

        def pick(kind: str, present: bool, type_name: str) -> Column:
            value = F.col(f"{kind}{i}") if present else F.lit(None)
            return value.cast(type_name)

        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"count{i}").alias("count"),
                pick("mean", c in numeric, "double").alias("mean"),
                pick("std", c in numeric, "double").alias("stddev"),
                pick("min", c in numeric, "double").alias("min_number"),
                pick("max", c in numeric, "double").alias("max_number"),
                pick("min", c in text, "string").alias("min_text"),
                pick("max", c in text, "string").alias("max_text"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def degenerate_columns(df: DataFrame) -> DataFrame:
    """``(column, count)`` of the numeric and text columns with at most one non-null value."""
    names = [c for c in df.columns if c in columns_of(df, NUMERIC + CATEGORICAL)]
    counts = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(names)))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count")) for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*rows))).filter("count <= 1")


def row_digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row that agree for rows equal in ``columns``; empty if no column can be hashed.

    Only plain types take part, with zeros of either sign alike; nested values
    and texts with a collation of their own are left to a full comparison.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = []
    for c in dict.fromkeys(columns):
        if isinstance(kinds[c], FractionalType) and not isinstance(kinds[c], DecimalType):
            plain.append(X.col(c) + F.lit(0.0))
        elif isinstance(kinds[c], (NumericType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType)) or kinds[c] == StringType():
            plain.append(X.col(c))
    return [F.xxhash64(F.lit(seed), *plain) for seed in ("a", "b")] if plain else []


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that occur more than once, with their number.

    Digests are counted first: 16 bytes of a row are shuffled. Only rows whose
    digest repeats are compared whole. Up to ``MANY_DIGESTS`` such digests are
    broadcast, so that unique rows are not shuffled; beyond that, a semi-join
    on digests picks the rows, with the bloom filter Spark puts before it.
    """
    columns = list(dict.fromkeys(columns or df.columns))
    digest = row_digest(df, columns)
    named = [X.col(c) for c in columns]
    if digest:
        names = ["__digest_a", "__digest_b"]
        while any(n.lower() in (c.lower() for c in columns) for n in names):
            names = [n + "_" for n in names]
        keys = [d.alias(n) for d, n in zip(digest, names)]
        repeated = materialise(df.select(*keys).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*names))
        few = repeated.limit(MANY_DIGESTS + 1).count() <= MANY_DIGESTS
        df = df.select(*named, *keys).join(F.broadcast(repeated) if few else repeated, names, "left_semi")
    return df.groupBy(*named).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def has_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> bool:
    return not duplicate_rows(df, columns).isEmpty()


def fill_null_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0.0)


# ---------------------------------------------------------------- correlation


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair ``(col_a, col_b, corr)`` of numbers and of indicators of levels.

    Nulls and NaN count as 0, a constant gives NaN, the diagonal is 1. Pairs
    of numbers come from blocks of ``MATRIX_WIDTH`` columns; pairs with levels
    from sums per level and joint counts, as rows that are made in tasks, so
    the number of levels has no limit but the rows of the result, which are
    its square. A table without rows has no entries.
    """
    columns = list(dict.fromkeys(columns))
    require(df, columns, NUMERIC + CATEGORICAL)
    df = df.select(*(F.col(quote(c)) for c in columns))
    numeric, categorical = columns_of(df, NUMERIC), columns_of(df, CATEGORICAL)
    parts = []
    if numeric:
        everything = list(range(len(numeric)))
        parts.append(_gramian(df, numeric, [number(c) for c in numeric], {i: everything for i in everything}, 1.0))
    if categorical:
        margins, n = _margins(df, categorical, numeric)
        ranked, sizes = _ranked(margins)
        named = _named(ranked)
        if numeric:
            levels = attach(margins.frame.drop(SALT, WEIGHT), named, {"column": "column", "level": "level"}, {"name": "__name"})
            found = [F.struct(F.lit(c).alias("number"), F.col(f"r{i}").alias("corr")) for i, c in enumerate(numeric)]
            mixed = levels.select(F.col("__name").alias("level"), F.inline(F.array(*found)))
            parts.append(_both_ways(mixed, "level", "number"))
        parts.append(_level_matrix(df, categorical, named, sizes, n))
    entry = F.coalesce("corr", F.lit(float("nan"))).alias("corr")
    return reduce(DataFrame.unionByName, parts).select("col_a", "col_b", entry)


def _both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair as two entries of a symmetric matrix."""
    there = F.struct(F.col(a).alias("col_a"), F.col(b).alias("col_b"), "corr")
    back = F.struct(F.col(b).alias("col_a"), F.col(a).alias("col_b"), "corr")
    return pairs.select(F.inline(F.array(there, back)))


def _named(ranked: KeyedTable) -> KeyedTable:
    """Add the ``name`` of each level's indicator; names that would repeat within a column get a number."""
    if ranked.small:
        rows = [r.asDict() for r in ranked.frame.collect()]
        rows.sort(key=lambda r: (r["column"], r["level"]))
        names = distinct_names(f"onehot_{r['column']}_is_{tag_name(r['level'])}" for r in rows)
        schema = StructType(ranked.frame.schema.fields + [StructField("name", StringType())])
        return KeyedTable(local_frame(ranked.frame.sparkSession, [{**r, "name": x} for r, x in zip(rows, names)], schema), ranked.keys, True)
    plain = F.concat(F.lit("onehot_"), "column", F.lit("_is_"), X.tag_text("level"))
    turn = F.row_number().over(Window.partitionBy("column", "__plain").orderBy("level"))
    again = F.row_number().over(Window.partitionBy("__name").orderBy("__turn", "column", "level"))
    named = (
        ranked.frame.withColumn("__plain", plain)
        .withColumn("__turn", turn)
        .withColumn("__name", F.when(F.col("__turn") == 1, F.col("__plain")).otherwise(F.concat_ws("_", "__plain", "__turn")))
        # A numbered name may be that of another level: its rank is its own.
        .withColumn("name", F.when(again == 1, F.col("__name")).otherwise(F.concat_ws("_", "__name", "column", "rank")))
    )
    return freeze(named.select(*(c for c in ranked.frame.columns if c != SALT), "name"), ["column", "level"])


def _level_matrix(df: DataFrame, columns: Sequence[str], named: KeyedTable, sizes: dict[str, int], n: int) -> DataFrame:
    """Phi coefficients of all pairs of levels, those that never meet included.

    Levels have places, and blocks of ``LEVEL_BLOCK`` places meet each other:
    a task holds pairs of two blocks, whatever the number of levels.
    """
    ends = [sum(sizes.get(c, 0) for c in columns[:i]) for i in range(len(columns) + 1)]
    before = F.create_map(*(F.lit(x) for pair in zip(columns, ends) for x in pair))
    place = (before[F.col("column")] + F.col("rank")).cast("bigint")
    levels = named.frame.select(place.alias("place"), "name", "share")
    blocks = F.sequence(F.lit(0), F.lit(ends[-1] // LEVEL_BLOCK))
    own = F.floor(F.col("place") / LEVEL_BLOCK).cast("int")

    def side(tag: str, block: str, other: str) -> DataFrame:
        mine = levels.select(*(F.col(c).alias(f"{c}_{tag}") for c in levels.columns), own.alias(block), F.explode(blocks).alias(other))
        return mine.filter("block_a <= block_b")

    pairs = side("a", "block_a", "block_b").join(side("b", "block_b", "block_a"), ["block_a", "block_b"]).filter("place_a <= place_b")
    n_ab = F.lit(0).cast("bigint").alias("n_ab")
    counted = pairs.withColumn("n_ab", n_ab)
    if len(columns) > 1:
        cells = _joint_counts(df, list(combinations(columns, 2)))
        for tag in "ab":
            found = {"rank": f"rank_{tag}"}
            cells = attach(cells, named, {"column": f"col_{tag}", "level": f"level_{tag}"}, found)
            cells = cells.withColumn(f"place_{tag}", (before[F.col(f"col_{tag}")] + F.col(f"rank_{tag}")).cast("bigint"))
        counted = pairs.join(cells.select("place_a", "place_b", "n_ab"), ["place_a", "place_b"], "left")
    share_a, share_b = F.col("share_a"), F.col("share_b")
    together = F.coalesce("n_ab", F.lit(0)) / F.lit(float(max(n, 1)))
    spread = F.sqrt(share_a * (1 - share_a) * share_b * (1 - share_b))
    phi = F.when(F.col("place_a") == F.col("place_b"), 1.0).otherwise(F.try_divide(together - share_a * share_b, spread))
    entries = counted.withColumn("corr", phi)
    apart = _both_ways(entries.filter("place_a < place_b"), "name_a", "name_b")
    same = entries.filter("place_a = place_b").select(F.col("name_a").alias("col_a"), F.col("name_b").alias("col_b"), "corr")
    return apart.unionByName(same)


def _gramian(df: DataFrame, names: Sequence[str], values: Sequence[Column], wanted: Mapping[int, Sequence[int]], same: float | None) -> DataFrame:
    """Pearson of the ``wanted`` pairs of positions, NaN for a constant; ``same`` is that of a column with itself.

    Columns are taken in pairs of blocks; a block pair is one pass with a
    matrix of bounded width on the driver, which sends it back a row at a time.
    """
    half = MATRIX_WIDTH // 2
    by_blocks: dict[tuple[int, int], dict[int, list[int]]] = {}
    for i, others in wanted.items():
        for j in others:
            by_blocks.setdefault(tuple(sorted((i // half, j // half))), {}).setdefault(i, []).append(j)
    label = F.array(*map(F.lit, names))
    parts = []
    for blocks, rows in by_blocks.items():
        taken = [i for b in dict.fromkeys(blocks) for i in range(b * half, min((b + 1) * half, len(names)))]
        place = {i: k for k, i in enumerate(taken)}
        vectors = df.select(array_to_vector(F.array(*(values[i] for i in taken))).alias("v"))
        if vectors.isEmpty():
            continue
        matrix = Correlation.corr(vectors, "v").first()[0].toArray()
        if same is not None:
            np.fill_diagonal(matrix, same)
        lines = [{"i": i, "others": js, "found": matrix[place[i], [place[j] for j in js]].tolist()} for i, js in rows.items()]
        local = local_frame(df.sparkSession, lines, "i int, others array<int>, found array<double>")
        parts.append(
            local.select("i", F.explode(F.arrays_zip("others", "found")).alias("e")).select(
                label[F.col("i")].alias("col_a"), label[F.col("e.others")].alias("col_b"), F.col("e.found").alias("corr")
            )
        )
    if not parts:
        return local_frame(df.sparkSession, [], "col_a string, col_b string, corr double")
    return reduce(DataFrame.unionByName, parts)


def number(column: str) -> Column:
    """A column as a double, null and NaN as 0."""
    value = F.col(quote(column)).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def _numeric_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson of pairs of numeric columns; null for a constant column.

    A few pairs are sums of one aggregation; many come from a matrix, whose
    cost per row grows with the square of the columns but not of expressions.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    if len(pairs) > 2 * len(names):
        place = {c: i for i, c in enumerate(names)}
        wanted: dict[int, list[int]] = {}
        for a, b in pairs:
            wanted.setdefault(place[a], []).append(place[b])
        found = _gramian(df, names, [number(c) for c in names], wanted, None)
        return found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    stats = df.agg(
        *(F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(names)),
        *(F.covar_pop(number(a), number(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)),
    )
    place = {c: i for i, c in enumerate(names)}
    rows = [
        F.struct(
            F.lit(a).alias("col_a"),
            F.lit(b).alias("col_b"),
            F.try_divide(F.col(f"c{k}"), F.col(f"s{place[a]}") * F.col(f"s{place[b]}")).alias("corr"),
        )
        for k, (a, b) in enumerate(pairs)
    ]
    return stats.select(F.inline(F.array(*rows)))


def _margins(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[KeyedTable, int]:
    """Per ``(column, level)``: share, odds, and the correlation with each number.

    One pass for the totals, one for all columns together by grouping sets.
    """
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(number(c)).alias(f"mean{i}") for i, c in enumerate(numeric)),
        *(F.var_pop(number(c)).alias(f"var{i}") for i, c in enumerate(numeric)),
    ).first()
    n = totals["n"]
    narrow = df.select(
        *map(quote, categorical),
        *((number(c) - F.lit(totals[f"mean{i}"])).alias(f"__y{i}") for i, c in enumerate(numeric)),
    )
    sums = [F.sum(f"__y{i}").alias(f"s{i}") for i in range(len(numeric))]
    rows = F.lit(float(max(n, 1)))
    share = F.col("share")
    table = (
        count_levels(narrow, categorical, sums)
        .filter("level is not null")
        .withColumn("share", F.col(WEIGHT) / rows)
        .select(
            "column",
            "level",
            WEIGHT,
            "share",
            F.try_divide(share, 1 - share).alias("odds"),
            *(
                F.try_divide(
                    F.col(f"s{i}") / rows, F.sqrt(F.lit(totals[f"var{i}"]) * share * (1 - share))
                ).alias(f"r{i}")
                for i in range(len(numeric))
            ),
        )
    )
    return freeze(table, ["column", "level"]), n


def level_correlation(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """``(column, level, number, corr)`` for each level's indicator against each number."""
    margins, _ = _margins(df, categorical, numeric)
    pairs = [F.struct(F.lit(c).alias("number"), F.col(f"r{i}").alias("corr")) for i, c in enumerate(numeric)]
    return margins.frame.select("column", "level", F.inline(F.array(*pairs)))


def _joint_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(col_a, col_b, level_a, level_b, n_ab)`` of the levels that occur together; null is no level."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(names)}
    keys = [F.col(f"k{i}") for i in range(len(names))]
    joint = (
        df.select(*(X.col(c).alias(f"k{place[c]}") for c in names))
        .groupingSets([[keys[place[a]], keys[place[b]]] for a, b in pairs], *keys)
        .agg(F.grouping_id().alias("which"), F.count(F.lit(1)).alias("n_ab"))
    )
    sides = []
    for a, b in pairs:
        hit = F.col("which") == grouping_set_id([place[a], place[b]], len(names))
        row = F.struct(
            F.lit(a).alias("col_a"),
            F.lit(b).alias("col_b"),
            keys[place[a]].alias("level_a"),
            keys[place[b]].alias("level_b"),
        )
        sides.append(F.when(hit, row))
    return (
        joint.select(F.coalesce(*sides).alias("cell"), "n_ab")
        .select("cell.*", "n_ab")
        .filter("level_a is not null and level_b is not null")
    )


def _level_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], margins: KeyedTable, n: int) -> DataFrame:
    """Strongest phi coefficient of each pair of categorical columns.

    Pairs of levels that occur together come from the joint counts. Of those
    that never do, phi is ``-sqrt(odds_a * odds_b)``, so for a level of A only
    the commonest level of B it never meets can matter. Ranking B's levels by
    odds, that is the first rank missing among the ranks the level meets: an
    anti-join of "the rank after one it meets" against the ranks it meets.
    """
    cells = _joint_counts(df, pairs)
    ranked, sizes = _ranked(margins)
    cells = attach(
        cells, margins, {"column": "col_a", "level": "level_a"}, {"share": "p_a", "odds": "odds_a"}
    )
    cells = attach(
        cells, ranked, {"column": "col_b", "level": "level_b"}, {"share": "p_b", "rank": "rank_b"}
    )
    cells = materialise(cells)
    spread = F.sqrt(F.col("p_a") * (1 - F.col("p_a")) * F.col("p_b") * (1 - F.col("p_b")))
    together = cells.select(
        "col_a",
        "col_b",
        F.try_divide(F.col("n_ab") / F.lit(float(max(n, 1))) - F.col("p_a") * F.col("p_b"), spread).alias("corr"),
    )

    # Every level of A starts at rank 0; a rank met offers the next one.
    partners = local_frame(
        df.sparkSession,
        [{"column": a, "col_b": b, "levels_b": sizes.get(b, 0)} for a, b in pairs],
        "column string, col_b string, levels_b bigint",
    )
    starts = (
        margins.frame.join(F.broadcast(partners), "column")
        .select(F.col("column").alias("col_a"), "col_b", F.col("level").alias("level_a"), "odds", "levels_b")
        .withColumn("rank_b", F.lit(0).cast("bigint"))
    )
    known = F.broadcast(partners.withColumnRenamed("column", "col_a"))
    nexts = cells.join(known, ["col_a", "col_b"]).select(
        "col_a", "col_b", "level_a", F.col("odds_a").alias("odds"), "levels_b", (F.col("rank_b") + 1).alias("rank_b")
    )
    met = cells.select("col_a", "col_b", "level_a", "rank_b")
    first_missing = (
        starts.unionByName(nexts)
        .filter("rank_b < levels_b")
        .join(met, ["col_a", "col_b", "level_a", "rank_b"], "left_anti")
        .groupBy("col_a", "col_b", "level_a")
        .agg(F.min("rank_b").alias("rank_b"), F.first("odds").alias("odds_a"))
        # Of all levels that ask for one rank only the largest odds can win: few rows join, and no key is hot.
        .groupBy("col_a", "col_b", "rank_b")
        .agg(F.max("odds_a").alias("odds_a"))
    )
    by_rank = KeyedTable(ranked.frame, ("column", "rank"), ranked.small, ranked.hot)
    apart = attach(first_missing, by_rank, {"column": "col_b", "rank": "rank_b"}, {"odds": "odds_b"}).select(
        "col_a", "col_b", (-F.sqrt(F.col("odds_a") * F.col("odds_b"))).alias("corr")
    )
    return together.unionByName(apart).groupBy("col_a", "col_b").agg(X.strongest("corr").alias("corr"))


def _ranked(margins: KeyedTable) -> tuple[KeyedTable, dict[str, int]]:
    """Add each level's rank within its column, commonest first, and the levels per column."""
    frame = margins.frame.select("column", "level", WEIGHT, "share", "odds")
    if margins.small:
        rows = sorted((r.asDict() for r in frame.collect()), key=lambda r: (r["column"], -r[WEIGHT], r["level"]))
        sizes: dict[str, int] = {}
        for row in rows:
            row["rank"] = sizes.get(row["column"], 0)
            sizes[row["column"]] = row["rank"] + 1
        schema = StructType(frame.schema.fields + [StructField("rank", LongType())])
        local = local_frame(frame.sparkSession, rows, schema)
        return KeyedTable(local, ("column", "level"), True), sizes
    numbered, _ = number_rows(frame, [F.col("column"), F.col(WEIGHT).desc(), F.col("level")], "position")
    bounds = numbered.groupBy("column").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("n")).collect()
    firsts = [{"column": r["column"], "start": r["start"]} for r in bounds]
    starts = local_frame(frame.sparkSession, firsts, "column string, start bigint")
    ranked = numbered.join(F.broadcast(starts), "column").select(
        "column", "level", WEIGHT, "share", "odds", (F.col("position") - F.col("start")).alias("rank")
    )
    return freeze(ranked, ["column", "level"]), {r["column"]: r["n"] for r in bounds}


def pair_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(col_a, col_b, corr)`` of the given pairs of columns.

    For a category the value of its strongest level counts, with its sign.
    Nulls count as 0 for numbers and as no level for categories.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    require(df, columns, NUMERIC + CATEGORICAL)
    df = df.select(*(F.col(quote(c)) for c in columns))
    numeric = set(columns_of(df, NUMERIC))
    parts = []
    both_numeric = [p for p in pairs if p[0] in numeric and p[1] in numeric]
    if both_numeric:
        parts.append(_numeric_pairs(df, both_numeric))
    mixed = [p for p in pairs if (p[0] in numeric) != (p[1] in numeric)]
    both_levels = [p for p in pairs if p[0] not in numeric and p[1] not in numeric]
    if mixed or both_levels:
        categorical = [c for c in columns if c not in numeric]
        numbers = [c for c in columns if c in numeric and any(c in p for p in mixed)]
        margins, n = _margins(df, categorical, numbers)
        if mixed:
            wanted = [
                F.when(
                    F.col("column") == (b if a in numeric else a),
                    F.struct(
                        F.lit(a).alias("col_a"),
                        F.lit(b).alias("col_b"),
                        F.col(f"r{numbers.index(a if a in numeric else b)}").alias("corr"),
                    ),
                )
                for a, b in mixed
            ]
            parts.append(
                margins.frame.select(F.explode(F.array(*wanted)).alias("entry"))
                .filter("entry is not null")
                .groupBy("entry.col_a", "entry.col_b")
                .agg(X.strongest(F.col("entry.corr")).alias("corr"))
            )
        if both_levels:
            parts.append(_level_pairs(df, both_levels, margins, n))
    return reduce(DataFrame.unionByName, parts)


def collapsed_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The full symmetric matrix of :func:`pair_correlation`, as rows; the diagonal is 1."""
    columns = list(dict.fromkeys(columns))
    diagonal = local_frame(
        df.sparkSession,
        [{"col_a": c, "col_b": c, "corr": 1.0} for c in columns],
        "col_a string, col_b string, corr double",
    )
    require(df, columns, NUMERIC + CATEGORICAL)
    if len(columns) < 2:
        return diagonal
    upper = pair_correlation(df, list(combinations(columns, 2)))
    flipped = F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    both = upper.select(F.inline(F.array(F.struct("col_a", "col_b", "corr"), flipped)))
    return both.unionByName(diagonal)


def top_correlated(df: DataFrame, target: str, candidates: Sequence[str] | None = None) -> DataFrame:
    """The ``(column, corr)`` most correlated with a numeric target; ties go by name.

    Empty unless there are at least two other columns to choose from.
    """
    if candidates is None:
        candidates = columns_of(df, NUMERIC + CATEGORICAL)
    others = [c for c in candidates if c != target]
    if len(others) < 2:
        return local_frame(df.sparkSession, [], "column string, corr double")
    pairs = pair_correlation(df, [(target, c) for c in others])
    return (
        pairs.filter("corr is not null and not isnan(corr)")
        .orderBy(F.abs("corr").desc(), "col_b")
        .limit(1)
        .select(F.col("col_b").alias("column"), "corr")
    )
