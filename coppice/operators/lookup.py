"""Joins against per-key tables, row numbers, filters and samples.

A *keyed table* has one row per key: levels and codes, group means, group
counts, places. :func:`freeze` measures one when it is fitted. Up to
``SMALL_ROWS`` rows with keys of at most ``SMALL_KEY_BYTES`` it becomes a local
relation and is broadcast. Beyond that it is stored in the shared folder and
joined by shuffle, where frequent keys take a separate, provably small
broadcast (at most ``HOT_SHARE`` keys can each hold more than one in
``HOT_SHARE`` rows) and the rows concerned are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DateType,
    MapType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from coppice.functions.columns import col, unit_hash
from coppice.functions.schema import quote
from coppice.session import materialise

SMALL_ROWS = 4096
SMALL_KEY_BYTES = 1024
HOT_SHARE = 1000

WEIGHT = "__weight"
SALT = "__salt"


@dataclass(frozen=True)
class KeyedTable:
    """One row per key. ``hot`` holds the frequent keys of a table that is not small."""

    frame: DataFrame
    keys: tuple[str, ...]
    small: bool
    hot: DataFrame | None = None

    @property
    def values(self) -> list[str]:
        return [c for c in self.frame.columns if c not in (*self.keys, WEIGHT, SALT)]


def local_frame(spark: SparkSession, rows: Sequence[Mapping], schema) -> DataFrame:
    """A small list of rows as a local relation."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.Table.from_pylist([dict(r) for r in rows], to_arrow_schema(schema)), schema)


def take_small(table: DataFrame) -> list[dict] | None:
    """All rows of ``table``, or None when there are many or when one is wide.

    Wide values are blanked before they leave the executors, so what reaches
    the driver is at most ``SMALL_ROWS + 1`` narrow rows.
    """
    wide = _is_wide(table)
    probe = table.select(*(F.when(~wide, F.col(c)).alias(c) for c in table.columns), wide.alias("__wide"))
    rows = probe.take(SMALL_ROWS + 1)
    if len(rows) > SMALL_ROWS or any(r["__wide"] for r in rows):
        return None
    return [{c: r[c] for c in table.columns} for r in rows]


def _is_wide(table: DataFrame) -> Column:
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    nested = any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in table.schema.fields)
    return reduce(or_, [F.coalesce(F.octet_length(c) > SMALL_KEY_BYTES, F.lit(False)) for c in texts], F.lit(nested))


def freeze(table: DataFrame, keys: Sequence[str], given: bool = False) -> KeyedTable:
    """Compute a table with unique ``keys`` once and settle how it will be joined.

    An optional ``__weight`` column says how many rows each key stood for. A
    table ``given`` by a caller is checked: a repeated key, which would
    multiply the rows it meets, is a ``ValueError``.
    """
    with computed_once(table) as cached:
        rows = take_small(cached)
        if given:
            if rows is not None:
                repeated = len({tuple(r[k] for k in keys) for r in rows}) < len(rows)
            else:
                repeated = not cached.groupBy(*keys).count().filter("count > 1").isEmpty()
            if repeated:
                raise ValueError(f"keys {', '.join(keys)} are repeated")
        if rows is not None:
            return KeyedTable(local_frame(table.sparkSession, rows, table.schema), tuple(keys), True)
        return large_table(materialise(cached.withColumn(SALT, F.lit(0))), keys)


@contextmanager
def computed_once(df: DataFrame) -> Iterator[DataFrame]:
    """Keep an aggregate between the look at its size and its storage."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()


def large_table(stored: DataFrame, keys: Sequence[str]) -> KeyedTable:
    """A keyed table beyond the broadcast bound, stored with its ``__salt`` column."""
    hot = _frequent(stored, stored) if WEIGHT in stored.columns else None
    return KeyedTable(stored, tuple(keys), False, hot)


def reopen(table: DataFrame, keys: Sequence[str]) -> KeyedTable:
    """The keyed table saved as ``table`` by an earlier session."""
    return large_table(table, keys) if SALT in table.columns else freeze(table, keys)


def _frequent(counted: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``counted`` whose key stands for more than one in ``HOT_SHARE`` rows.

    There are fewer than ``HOT_SHARE`` of them, so they fit in a local
    relation. Wide ones are left to the adaptive skew join.
    """
    total = rows.agg(F.sum(WEIGHT) if WEIGHT in rows.columns else F.count(F.lit(1))).first()[0] or 0
    hot = counted.filter((F.col(WEIGHT) > total / HOT_SHARE) & ~_is_wide(counted))
    return local_frame(counted.sparkSession, [r.asDict() for r in hot.collect()], counted.schema)


def count_keys(df: DataFrame, keys: Mapping[str, Column | str]) -> DataFrame:
    """Rows per key, counted map-side first; the count is the ``__weight`` column."""
    return df.groupBy(*(col(c).alias(k) for k, c in keys.items())).agg(F.count(F.lit(1)).alias(WEIGHT))


def grouping_set_id(members: Sequence[int], width: int) -> int:
    """The ``grouping_id`` of the set that keeps ``members``: one bit per column left out."""
    return sum(1 << (width - 1 - i) for i in range(width) if i not in members)


def count_levels(df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """``(column, level, __weight, ...)`` of several text columns, from one pass.

    ``extra`` are further aggregates per level.
    """
    keys = [F.col(f"__key_{i}") for i in range(len(columns))]
    keyed = df.select("*", *(col(c).alias(f"__key_{i}") for i, c in enumerate(columns)))
    counted = keyed.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias(WEIGHT), *extra
    )
    column, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (c, key) in enumerate(zip(columns, keys)):
        mine = F.col("__set") == grouping_set_id([i], len(columns))
        column, level = F.when(mine, F.lit(c)).otherwise(column), F.when(mine, key).otherwise(level)
    return counted.select(column.alias("column"), level.alias("level"), *counted.columns[len(columns) + 1 :])


def small_levels(counted: DataFrame) -> dict[str, list[dict]]:
    """The rows of each column of :func:`count_levels` that has few and narrow levels."""
    sizes = counted.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("level")).alias("width"))
    small = {
        r["column"]: r["n"]
        for r in sizes.collect()
        if r["n"] <= SMALL_ROWS and (r["width"] or 0) <= SMALL_KEY_BYTES
    }
    batches = [list(small)] if sum(small.values()) <= SMALL_ROWS else [[c] for c in small]
    found: dict[str, list[dict]] = {c: [] for c in small}
    for batch in batches:
        for row in counted.filter(F.col("column").isin(batch)).collect():
            values = row.asDict()
            found[values.pop("column")].append(values)
    return found


def attach(
    df: DataFrame,
    table: KeyedTable,
    on: Mapping[str, Column | str],
    values: Mapping[str, str],
    null_safe: bool = False,
) -> DataFrame:
    """Left-join ``values`` (table column -> new name) of a keyed table to ``df``.

    ``on`` maps the table's keys to columns or expressions of ``df``. Row count
    and other columns of ``df`` are unchanged; a key not in the table gives
    nulls. Null keys match a null key only if ``null_safe``.
    """
    def side(frame: DataFrame, prefix: str, extra: Sequence[str] = ()) -> DataFrame:
        return frame.select(
            *(F.col(k).alias(f"{prefix}k_{k}") for k in table.keys),
            *(F.col(v).alias(f"{prefix}v_{v}") for v in values),
            *(F.col(e) for e in extra),
        )

    def matching(prefix: str) -> Column:
        pairs = [(col(on[k]), F.col(f"{prefix}k_{k}")) for k in table.keys]
        return reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])

    original = [F.col(quote(c)) for c in df.columns if c not in values.values()]
    if table.small:
        joined = df.join(F.broadcast(side(table.frame, "__t_")), matching("__t_"), "left")
        return joined.select(*original, *(F.col(f"__t_v_{v}").alias(name) for v, name in values.items()))

    hot = table.hot
    if hot is None:
        hot = _hot_entries(df, table, on)
    hot = side(hot.withColumn("__found", F.lit(True)), "__h_", ["__found"])
    spread_by = _spread_columns(df, on)
    # Many more values than tasks, so that hashing them fills the tasks evenly.
    spread_over = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no_partner = F.col("__found").isNotNull()
    if not null_safe:
        no_partner = reduce(or_, [col(c).isNull() for c in on.values()], no_partner)
    spread = F.when(no_partner, F.pmod(F.xxhash64(*spread_by), F.lit(spread_over)).cast("int") + 1).otherwise(0)
    joined = (
        df.join(F.broadcast(hot), matching("__h_"), "left")
        .withColumn("__spread", spread)
        .join(
            side(table.frame, "__t_", [SALT]),
            matching("__t_") & (F.col("__spread") == F.col(SALT)),
            "left",
        )
    )
    return joined.select(
        *original,
        *(
            F.when(F.col("__found"), F.col(f"__h_v_{v}")).otherwise(F.col(f"__t_v_{v}")).alias(name)
            for v, name in values.items()
        ),
    )


def _hot_entries(df: DataFrame, table: KeyedTable, on: Mapping[str, Column | str]) -> DataFrame:
    """What the frequent keys of ``df`` are joined with; nulls for a key the table lacks.

    Fewer than ``HOT_SHARE`` keys, all narrow. Keys with a wide entry stay with
    the shuffle join.
    """
    keys = _frequent(count_keys(df, on), df).select(*table.keys)
    wide = _is_wide(table.frame)
    entries = table.frame.join(F.broadcast(keys), _same(table.frame, keys, table.keys), "left_semi").select(
        *table.keys, *(F.when(~wide, F.col(v)).alias(v) for v in table.values), wide.alias("__wide")
    )
    found = {tuple(r[k] for k in table.keys): r.asDict() for r in entries.collect()}
    rows = []
    for key in keys.collect():
        row = found.get(tuple(key), {**dict.fromkeys(table.values), **key.asDict(), "__wide": False})
        if not row.pop("__wide"):
            rows.append(row)
    return local_frame(df.sparkSession, rows, entries.drop("__wide").schema)


def _spread_columns(df: DataFrame, on: Mapping[str, Column | str]) -> list[str]:
    """Columns that tell rows of one key apart: the fixed-width ones, or all if those are few.

    A hash of columns, unlike a random number, is the same when a lost task is
    repeated. Texts are left out if possible, so that they need not be read.
    """
    keys = {c for c in on.values() if isinstance(c, str)}
    fixed = [
        quote(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (NumericType, DateType, TimestampType, TimestampNTZType)) and f.name not in keys
    ]
    if len(fixed) > 1:
        return fixed
    return [quote(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def enrich_by_key(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute columns once per distinct key and join them back; null keys get nulls.

    ``compute`` gets the distinct keys and adds columns. Worth it only for
    expensive functions; plain expressions are cheaper in place.
    """
    counted = count_keys(df.filter(F.col(key).isNotNull()), {key: key})
    table = freeze(compute(counted), [key])
    return attach(df, table, {key: key}, {v: v for v in table.values})


def join_group_counts(df: DataFrame, key: str, output: str, bucket: Column | None = None) -> DataFrame:
    """Add how many rows share the key; a null key gets null."""
    expression = F.col(key) if bucket is None else bucket
    table = freeze(count_keys(df, {"key": expression}).withColumn("n", F.col(WEIGHT)), ["key"])
    return attach(df, table, {"key": expression}, {"n": output})


def dictionary_lookup(df: DataFrame, key: str, dictionary: DataFrame | Mapping, output: str) -> DataFrame:
    """Replace a key by its entry in a two-column table or a Python mapping; null is a key."""
    if not isinstance(dictionary, DataFrame):
        pairs = list(dictionary.items())
        local = pa.table({"key": [k for k, _ in pairs], "value": [v for _, v in pairs]})
        dictionary = df.sparkSession.createDataFrame(local)
    source, target = dictionary.columns
    table = freeze(dictionary, [source], given=True)
    return attach(df, table, {source: key}, {target: output}, null_safe=True)


def number_rows(df: DataFrame, order: Sequence[Column | str], output: str) -> tuple[DataFrame, int]:
    """Add the position of each row (from 0) in a total order; also return the row count.

    The rows are range-partitioned and sorted once and stored; positions come
    from the position within the partition plus the sizes of the partitions
    before it, so no task sees more than its own partition.
    """
    offset_bits = 33
    fixed = materialise(
        df.orderBy(*(col(c) for c in order)).withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("__place", offset_bits).cast("int")
    within = F.col("__place").bitwiseAND(F.lit((1 << offset_bits) - 1))
    sizes = sorted(fixed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for row in sizes:
        starts.append({"part": row["part"], "start": total})
        total += row["count"]
    if len(starts) <= 1:
        return fixed.withColumn(output, within).drop("__place"), total
    offsets = local_frame(df.sparkSession, starts, "part int, start bigint")
    numbered = fixed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.select(*map(quote, df.columns), (F.col("start") + within).alias(output)), total


def positional_join(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], value: str
) -> DataFrame:
    """Give the i-th row of ``left`` the ``value`` of the i-th row of ``right``.

    Both orders must be total. Unequal row counts are a ``ValueError``.
    """
    a, n_left = number_rows(left, left_order, "__position")
    b, n_right = number_rows(right, right_order, "__position")
    if n_left != n_right:
        raise ValueError(f"{n_left} rows cannot take {n_right} values")
    return a.join(b.select("__position", value), "__position").drop("__position")


def filter_by_dict(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows whose columns all equal the given values; None selects nulls."""
    conditions = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in wanted.items()]
    return df.filter(reduce(and_, conditions, F.lit(True)))


def sample_to_cap(df: DataFrame, cap: int, key: Sequence[str], seed: int = 7) -> DataFrame:
    """Keep every row up to ``cap`` rows, beyond that each with probability ``cap / rows``.

    The choice depends on the key and seed alone, so repeating it gives the
    same rows; nothing is sorted or gathered.
    """
    rows = df.count()
    if rows <= cap:
        return df
    return df.filter(unit_hash(f"sample/{seed}", *key) < F.lit(cap / rows))


#: Bits of a hash that one pass of :func:`sample_exactly` looks at, and bits of the hash.
DRAW_BITS, HASH_BITS = 16, 52


def sample_exactly(df: DataFrame, cap: int, key: Sequence[str], seed: int = 7) -> DataFrame:
    """The ``cap`` rows with the smallest hashes of key and seed; all rows if there are no more.

    The bound is found by counting hashes by their first 16 bits, then within
    the range that holds the last row by the next 16, and so on: two narrow
    passes for up to billions of rows, and a filter, without a sort. Only rows
    that share the very last hash, of a repeated key say, are put in order, by
    a hash of their values; rows equal in all columns stand for each other.
    """
    draw = (unit_hash(f"sample/{seed}", *key) * F.lit(float(1 << HASH_BITS))).cast("bigint")
    low, shift, wanted, rest = 0, HASH_BITS, cap, df.select(draw.alias("draw"))
    while shift and wanted > 0:
        width = min(DRAW_BITS, shift)
        shift -= width
        counted = rest.groupBy(F.shiftrightunsigned("draw", shift).alias("part")).count()
        parts = sorted((r["part"], r["count"]) for r in counted.collect())  # 2 ** 16 rows at most
        if low == 0 and shift == HASH_BITS - width and sum(n for _, n in parts) <= cap:
            return df
        for part, n in parts:
            if n > wanted:
                break
            wanted -= n
            low = (part + 1) << shift
        else:  # the last range is taken whole
            break
        if wanted == 0:
            break
        low = part << shift
        rest = rest.filter(F.shiftrightunsigned("draw", shift) == part)
    taken = df.filter(draw < F.lit(low))
    if wanted <= 0 or cap <= 0:
        return taken
    tied = df.filter(draw == F.lit(low))
    whole = F.xxhash64(*(col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()))
    return taken.unionByName(tied.orderBy(whole).limit(wanted))
