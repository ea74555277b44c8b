"""Exact components of texts whose shingle sets are similar: a join by rare shingles, profiles and pivots.

Unrelated texts all have Jaccard distance 1, which no document pivot can tell
apart; the first regions are therefore those of single rare shingles: two linked
sets always share one among the rarest 15 % of each (for a similarity of 0.85).
In a large region some members are drawn as pivots and compared with all
members that are not connected with them yet and whose profiles allow a link.

The windows of the triangle inequality (|d(x, p) - d(y, p)| <= t for a link of
distance at most t) are used once, after the first pivots: members within 3 t of
any pivot form one region, and if some member is beyond 2 t of all pivots, those
without a pivot within t form another. This is no Voronoi partition: members are
not dealt to their nearest pivot. There are no windows after that, because pairs
that are connected already are not compared, so their distances are not known.
From then on pivots, which have met all members, leave their region, and 16 times
as many are drawn, until few members are outside its largest connected part or
it is small. A large region of unlinked members is thus screened pair by pair,
with profiles; its work grows with the square of its members. No link is lost.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.components import components
from coppice.llm.textwork import (
    WordHashes, col, mixed, pick, release, split_words, squeeze, squeeze_sorted, text_slices, unsqueeze, unsqueeze_sorted,
)
from coppice.session import store_columns

#: Bytes of text that a task holds as numbers at a time.
AT_ONCE = 2_000_000
#: Members up to which a region is joined directly.
SMALL_REGION = 24
#: Pivots of a region at first, and how many times as many at each further level.
FIRST_PIVOTS, MORE_PIVOTS = 4, 16
#: Members of a region that one task compares with the pivots at a time.
BLOCK = 4096
#: The frequency table that orders shingles has 2 ** COUNT_BITS cells, whatever the input.
COUNT_BITS, COUNT_PART_BITS = 21, 16
#: Cells of a set's profile: their differences bound the distance of two sets from below.
PROFILE = 512
#: Bits of the filter that keeps rows which cannot meet a join out of its shuffle.
FILTER_BITS = 24
_WORDS = WordHashes()
_WORDS.LIMIT = 60_000
# Odd multipliers of the rolling combination.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP = np.uint64(64 - COUNT_BITS)


def shingles(data: list[bytes | None], width: int = 4) -> list[np.ndarray]:
    """For each text the hashes of all its word shingles in order, repeats included; a shorter text is one shingle."""
    split = [split_words(t) for t in data]
    hashes, total = _WORDS.of(list(chain.from_iterable(split))), np.uint64(0)
    count = max(len(hashes) - width + 1, 0)
    for i in range(width):
        total = (total * _A + _B) ^ (hashes[i : i + count] * _C)
    total = mixed(total)
    out, start = [], 0
    for words in split:
        n = len(words)
        if n >= width:
            out.append(total[start : start + n - width + 1])
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=width)] if n else [], np.uint64))
        start += n
    return out


def _digest(distinct: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(distinct.tobytes())


def _profile(distinct: np.ndarray) -> bytes:
    counts = np.bincount((distinct & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _needed(n: int, percent: int) -> int:
    """Common shingles that a set of ``n`` needs for any link."""
    return -(-percent * n // 100)


def _frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """How many shingles fall into each cell of the frequency table, over all texts."""
    part_size = 1 << COUNT_PART_BITS

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, data in text_slices(batch.column(0), AT_ONCE):
                if found := shingles(data, width):
                    np.add.at(total, (np.concatenate(found) >> _TOP).astype(np.int64), 1)
            release()
        parts = [squeeze(total[i : i + part_size]) for i in range(0, len(total), part_size)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int64()), "counts": pa.array(parts, pa.binary())})

    def add(key, table):
        total = sum(unsqueeze(x) for x in table["counts"].to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([squeeze(total)], pa.binary())})

    schema = "part long, counts binary"
    parts = rows.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    for r in parts:
        out[r["part"] * part_size : (r["part"] + 1) * part_size] = unsqueeze(r["counts"])
    # Only their order counts, and equal counts must stay equal, so dense ranks do.
    return np.unique(out, return_inverse=True)[1].astype(np.uint32)


def _regions(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """First regions and all documents.

    Regions have ``cell``, ``cls`` (digest of a distinct set) and ``n``, with
    at least two sets each; documents have ``id``, ``cls`` (null without
    shingles), ``n`` and ``text_name``, a digest of the text.
    """
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = ("keys", "owner", "names", "sizes")
    held = spark.sparkContext.broadcast(_frequencies(rows, width))

    def route(batches):
        frequency = held.value
        for batch in batches:
            for part, data in text_slices(batch.column(1), AT_ONCE):
                known: dict[bytes, tuple[int, int]] = {}
                keys, owner, described = [], [], []
                for found in shingles(data, width):
                    distinct = np.unique(found)
                    n = len(distinct)
                    name = _digest(distinct) if n else None
                    described.append((name, n))
                    if not n or name in known:
                        continue
                    known[name] = len(known), n
                    order = np.lexsort((distinct, frequency[(distinct >> _TOP).astype(np.int64)]))
                    keys.append(distinct[order[: n - _needed(n, percent) + 1]])
                    owner.append(np.full(len(keys[-1]), len(known) - 1))
                count = len(described)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0)[part.start : part.stop], "cls": pa.array([x for x, _ in described], pa.binary()),
                    "n": pa.array([n for _, n in described], pa.int64()),
                    "text_name": pa.array([xxhash.xxh3_128_digest(t or b"") for t in data], pa.binary()),
                    "bucket": pa.nulls(count, pa.int64())} | {c: pa.nulls(count, pa.binary()) for c in blobs})
                if not keys:
                    continue
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                number = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(number, kind="stable")
                found, starts = np.unique(number[order], return_index=True)
                names = np.frombuffer(b"".join(known), np.uint8).reshape(-1, 16)
                sizes = np.array([n for _, n in known.values()], np.int64)
                out = []
                for b, at in zip(found, np.split(order, starts[1:])):
                    used, local = np.unique(owner[at], return_inverse=True)
                    out.append((b, squeeze_sorted(keys[at]), squeeze(local.astype(np.int64)), names[used].tobytes(), squeeze(sizes[used])))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.nulls(len(out), batch.column(0).type), "cls": pa.nulls(len(out), pa.binary()),
                    "n": pa.nulls(len(out), pa.int64()), "text_name": pa.nulls(len(out), pa.binary())} | {
                    k: pa.array(x, t) for k, x, t in zip(("bucket", *blobs), zip(*out), (pa.int64(), *[pa.binary()] * 4))})
                del keys, owner, out, known, number, order, names, sizes
            release()

    def meet(key, table):
        release()
        keys, names, sizes = [], [], []
        for row in table.to_pylist():
            at = unsqueeze(row["owner"])
            keys.append(unsqueeze_sorted(row["keys"], np.uint64))
            names.append(np.frombuffer(row["names"], np.uint64).reshape(-1, 2)[at])
            sizes.append(unsqueeze(row["sizes"])[at])
        keys, names, sizes = np.concatenate(keys), np.concatenate(names), np.concatenate(sizes)
        same = np.isin(keys, _repeated(keys))
        keys, names, sizes = keys[same], names[same], sizes[same]
        order = np.lexsort((names[:, 1], names[:, 0], sizes, keys))
        keys, names, sizes = keys[order], names[order], sizes[order]
        fresh = np.ones(len(keys), bool)  # copies from different batches are one set
        fresh[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]).any(axis=1)
        keys, names, sizes = keys[fresh], names[fresh], sizes[fresh]
        starts = np.ones(len(keys), bool)  # sets of too different sizes are apart (the empty set as pivot)
        starts[1:] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
        cells, done = [], set()
        first = np.flatnonzero(starts)
        for a, b in zip(first, np.append(first[1:], len(keys))):
            if b - a > 1:
                # Regions with the same members are one region.
                cell = xxhash.xxh3_64_intdigest(names[a:b].tobytes()) - (1 << 63)
                if cell not in done:
                    done.add(cell)
                    cells.append((cell, a, b))
        at = np.concatenate([np.arange(a, b) for _, a, b in cells]) if cells else np.zeros(0, np.int64)
        return pa.table({
            "cell": pa.array(np.repeat(np.array([c for c, _, _ in cells], np.int64), [b - a for _, a, b in cells]), pa.int64()),
            "cls": pa.array([x.tobytes() for x in names[at]], pa.binary()), "n": pa.array(sizes[at], pa.int64())})

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cls binary, n long, text_name binary, bucket long, " + ", ".join(f"{c} binary" for c in blobs)
    routed = store_columns(rows.select("id", "text").mapInArrow(route, schema))
    met = routed.where("bucket is not null").select("bucket", *blobs).groupBy("bucket")
    cells = met.applyInArrow(meet, "cell long, cls binary, n long")
    return store_columns(cells.distinct()), routed.where("bucket is null").select("id", "cls", "n", "text_name")


def _repeated(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def _filter_of(rows: DataFrame):
    """A bitmap of fixed size with a bit for each ``cls`` of ``rows``, or nearly so: it has no false misses.

    A name's bit is its first three bytes as a number.
    """
    part = 1 << 15  # bits of one aggregated bitmap
    place = F.conv(F.hex(F.substring("cls", 1, FILTER_BITS // 8)), 16, 10).cast("long")
    found = rows.select(place.alias("place")).groupBy(F.floor(F.col("place") / part).alias("part")).agg(
        F.bitmap_construct_agg(F.col("place") % part).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in found.collect():
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def _may_contain(bits: np.ndarray, names: pa.Array) -> pa.Array:
    at = np.array([int.from_bytes(x[: FILTER_BITS // 8], "big") for x in names.to_pylist()], np.int64)
    return pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool))


def _sets(rows: DataFrame, documents: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``cls``, ``n``, profile and packed text, once for each set that may be among ``members``."""
    known = _chosen(documents.where("cls is not null").select("cls", "text_name"), members).select(F.col("text_name").alias("cls"))
    held = _filter_of(known)

    def describe(batches):
        pack = zstandard.ZstdCompressor(level=3)
        sent: set[bytes] = set()  # by this task, so that copies of a set leave it once
        for batch in batches:
            for _, data in text_slices(batch.column(0), AT_ONCE):
                data = {xxhash.xxh3_128_digest(t): t for t in data if t}
                if data:
                    may = _may_contain(held.value, pa.array(list(data), pa.binary())).to_pylist()
                    data = [t for t, m in zip(data.values(), may) if m]
                found = [np.unique(x) for x in shingles(data, width)] if data else []
                once = {_digest(x): (len(x), _profile(x), t) for t, x in zip(data, found) if len(x)}
                once = {name: x for name, x in once.items() if name not in sent}
                if len(sent) > 100_000:
                    sent.clear()
                sent.update(once)
                yield pa.RecordBatch.from_pydict({
                    "cls": pa.array(list(once), pa.binary()), "n": pa.array([x[0] for x in once.values()], pa.int64()),
                    "profile": pa.array([x[1] for x in once.values()], pa.binary()),
                    "packed": pa.array([pack.compress(x[2]) for x in once.values()], pa.binary())})
            release()

    found = rows.select("text").mapInArrow(describe, "cls binary, n long, profile binary, packed binary")
    return store_columns(found.groupBy("cls").agg(
        F.first("n").alias("n"), F.first("profile").alias("profile"), F.first("packed").alias("packed")))


def _chosen(table: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``cls`` may be among ``names``, without a shuffle."""
    return _among(table, _filter_of(names))


def _among(table: DataFrame, held) -> DataFrame:
    def keep(batches):
        for batch in batches:
            yield batch.filter(_may_contain(held.value, batch.column("cls")))
            release()

    return table.mapInArrow(keep, table.schema)


def _reaches(one: np.ndarray, others: np.ndarray, sizes: np.ndarray, reach: int) -> np.ndarray:
    """Whether profiles allow 100 common >= reach all: common <= (sizes - apart) / 2 and all >= (sizes + apart) / 2."""
    apart = np.abs(one - others).sum(axis=-1)
    return 100 * (sizes - apart) >= reach * (sizes + apart)


def _profiles(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)


def _screened(members: DataFrame, pivots: DataFrame, sets: DataFrame, reach: int) -> DataFrame:
    """Pivots of a region and members, not connected with them, that profiles allow to be within reach.

    A region's members are dealt to blocks of bounded size, and its pivots go to each of them.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    profiles = sets.select("cls", "n", "profile")
    dealt = members.join(profiles, "cls").select("cell", F.pmod(F.xxhash64("cls"), blocks).alias("block"), "cls", "label", "n", "profile")
    sent = pivots.join(profiles, "cls").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), F.col("cls").alias("pivot"),
        F.col("label").alias("pivot_label"), F.col("n").alias("pivot_n"), F.col("profile").alias("pivot_profile"))

    def screen(key, members, pivots):
        release()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if members.num_rows and pivots.num_rows:
            grid, sizes = _profiles(members["profile"]), members["n"].to_numpy()
            labels = np.array(members["label"].to_pylist(), object)
            for i, (one, n, label) in enumerate(zip(
                    _profiles(pivots["pivot_profile"]), pivots["pivot_n"].to_numpy(), pivots["pivot_label"].to_pylist())):
                at = np.flatnonzero(_reaches(one, grid, sizes + n, reach) & (labels != label))
                out.append((at, np.full(len(at), i)))
        at, which = (pa.array(np.concatenate(x)) for x in zip(*out))
        cls, pivot = members["cls"].take(at), pivots["pivot"].take(which)
        return pa.table({"cell": pa.array(np.full(len(at), key[0].as_py()), pa.int64()), "cls": cls, "pivot": pivot})

    found = dealt.groupBy("cell", "block").cogroup(sent.groupBy("cell", "block")).applyInArrow(screen, "cell long, cls binary, pivot binary")
    return store_columns(found.select("cell", "cls", "pivot", F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")))


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``reach`` of the pairs whose profiles allow a distance within their reach."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    profiles = _chosen(sets.select("cls", "n", "profile"), ends)
    side = lambda c: profiles.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("profile").alias(f"profile_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def bound(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            reach = batch.column("reach").to_numpy()
            keep = _reaches(_profiles(batch.column("profile_a")), _profiles(batch.column("profile_b")), sizes, reach)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b", "reach")})
            release()

    return joined.mapInArrow(bound, "a binary, b binary, reach int")


def _distances(near: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """``a``, ``b``, ``common`` and ``all`` (shingles) of the pairs with 100 common >= ``reach`` all; each has its reach."""
    ends = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls")))
    packed = _chosen(sets.select("cls", "packed"), ends)
    whole = near.join(packed.select(F.col("cls").alias("a"), F.col("packed").alias("text_a")), "a").join(
        packed.select(F.col("cls").alias("b"), F.col("packed").alias("text_b")), "b")

    def compare(batches):
        unpack = zstandard.ZstdDecompressor()
        kept: dict[bytes, np.ndarray] = {}

        def of(name, data):
            if name not in kept:
                if len(kept) >= 100 or sum(x.nbytes for x in kept.values()) > AT_ONCE:
                    kept.clear()
                kept[name] = np.unique(shingles([unpack.decompress(data)], width)[0])
            return kept[name]

        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 500):  # so that few packed texts are copied at a time
                batch = whole_batch.slice(first, 500)
                common, every = [], []
                for row in batch.to_pylist():
                    x, y = of(row["a"], row["text_a"]), of(row["b"], row["text_b"])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    common.append(both)
                    every.append(len(x) + len(y) - both)
                common, every = np.array(common, np.int64), np.array(every, np.int64)
                keep = pa.array(100 * common >= batch.column("reach").to_numpy() * every)
                yield pa.RecordBatch.from_pydict({
                    "a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep),
                    "common": pa.array(common).filter(keep), "all": pa.array(every).filter(keep)})
            release()

    return store_columns(whole.mapInArrow(compare, "a binary, b binary, common long, all long"))


def _join_regions(regions: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """``cls`` and ``label``, the smallest set connected with it, of every set in ``regions``."""
    # Distances of t, 2 t and 3 t as shares of common shingles.
    linked, home, boundary = (max(100 - i * (100 - percent), 0) for i in (1, 2, 3))
    share = lambda least: 100 * F.col("common") >= least * F.col("all")
    labels = store_columns(regions.select("cls", F.col("cls").alias("label")).distinct())
    seen = None
    level = 0
    while True:
        named = regions.join(labels, "cls")
        by_label = named.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
        live = by_label.groupBy("cell").agg(
            F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels"))
        live = live.where("labels > 1").select("cell", "size", F.col("most.label").alias("main"), (F.col("size") - F.col("most.n")).alias("outside"))
        members = store_columns(named.join(live, "cell"))
        # Once few are outside the largest connected part of a large region, these are the pivots, and the region is done.
        pivots_drawn = FIRST_PIVOTS * MORE_PIVOTS**level
        last = F.col("outside") <= pivots_drawn
        few, many, going_on = members.agg(
            F.count_if(F.col("size") <= SMALL_REGION), F.count_if(F.col("size") > SMALL_REGION),
            F.count_if((F.col("size") > SMALL_REGION) & ~last)).first()
        if not few and not many:
            return labels
        # The members of a small region are compared with each other, where not connected yet.
        small = members.where(F.col("size") <= SMALL_REGION).select("cell", "cls", "label")
        other = small.select("cell", F.col("cls").alias("b"), F.col("label").alias("label_b"))
        within = small.join(other, "cell").where("cls < b and label != label_b").select(F.col("cls").alias("a"), "b")
        pairs = within.select("a", "b", F.lit(linked).alias("reach"), F.lit(False).alias("screened"))
        # Of a large one, some members are pivots, compared with all that are not connected with them yet.
        large = members.where(F.col("size") > SMALL_REGION)
        slot = F.when(last, F.xxhash64("cls")).otherwise(F.pmod(F.xxhash64("cls", F.lit(level)), F.lit(pivots_drawn)))
        drawn = large.where(~last | (F.col("label") != F.col("main"))).groupBy("cell", slot.alias("slot")).agg(
            F.min(F.struct("cls", "label")).alias("x"), F.first("size").alias("size"))
        if many:
            pivots = store_columns(drawn.select("cell", F.col("x.cls").alias("cls"), F.col("x.label").alias("label"), "size"))
            # What is far is of use for windows only, so pairs of small regions need not reach beyond a link.
            reach = linked if level else boundary
            met = _screened(large, pivots, sets, reach)
            far = met.select("a", "b", F.lit(reach).alias("reach"), F.lit(True).alias("screened"))
            pairs = pairs.unionByName(far) if few else far
        pairs = pairs.groupBy("a", "b").agg(F.min("reach").alias("reach"), F.max("screened").alias("screened"))
        pairs = store_columns(pairs if seen is None else pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        allowed = pairs.where("screened").select("a", "b", "reach")
        if few:  # those screened with pivots have passed by their profiles already
            allowed = store_columns(allowed.unionByName(_bounded(pairs.where("not screened").drop("screened"), sets)))
        near = _distances(allowed, sets, width)
        seen = pairs if seen is None else seen.unionByName(pairs)
        # Linked sets are connected; so are their labels.
        left, right = (labels.select(F.col("cls").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        links = near.where(share(linked)).join(left, "a").join(right, "b")
        roots = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        labels = store_columns(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select(
            "cls", F.coalesce("root", "label").alias("label")))
        # The regions of the next level; pivots have been compared with all members of theirs and are done.
        if not going_on:
            return labels
        large = large.where(~last)
        rest = large.select("cell", "cls").join(pivots.select("cell", "cls"), ["cell", "cls"], "left_anti")
        level += 1
        if level > 1:  # distances within a connected part are not known, so there are no windows to split by
            regions = store_columns(rest)
            continue
        # Pivots of one region that are near each other would have the same members, so they share one.
        reach = met.join(near, ["a", "b"]).groupBy("cell", "cls").agg(
            F.max(share(linked)).alias("inner"), F.max(share(home)).alias("home"))
        placed = rest.join(reach, ["cell", "cls"], "left").withColumn("far", ~F.coalesce("home", F.lit(False)))
        placed = store_columns(placed.select("cell", "cls", "far", F.col("inner").isNotNull().alias("near"),
                                             F.coalesce("inner", F.lit(False)).alias("inner")))
        # Without members beyond 2 t of all pivots, no pair needs the region of the rest.
        apart = placed.where("far").select("cell").distinct()
        regions = store_columns(placed.where("near").select(F.xxhash64("cell", F.lit("near")).alias("cell"), "cls").unionByName(
            placed.where("not inner").join(apart, "cell").select(F.xxhash64("cell", F.lit("rest")).alias("cell"), "cls")).distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4,
                    percent: int = 85) -> DataFrame:
    """Components of documents whose word shingle sets have a Jaccard similarity of ``percent`` % or more.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text with
    fewer than ``width`` words is one shingle. Returns one row per input row:
    ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable
    by links, its own included. No links are lost: all pairs that may be linked
    are compared by their whole texts or known to be connected already.

    A null text or one without words has no shingles, links with nothing and
    is its own component. Rows with equal ids are separate documents. Rows
    with a null id link like others, but lend no id; a component of such rows
    alone has a null id. Other columns are not read; no rows give no rows.
    Sets are told apart by 64-bit hashes of shingles and 128-bit digests.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    rows = pick(docs, id=id_column, text=text_column)
    regions, described = _regions(rows, width, percent)
    sets = _sets(rows, described, regions, width)
    labels = _join_regions(regions.select("cell", "cls"), sets, width, percent)
    least = described.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("least"))
    least = store_columns(least.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    component = least.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = least.join(component, "label").select("cls", "component_id")
    found = described.select("id", "cls", "n").join(of_set, "cls", "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near duplicates, with all its columns as they were.

    The row with the smallest id stays (null before any id), and of several such rows the one with the
    smallest hash. Rows without shingles link with nothing and all stay. Only
    rows that may be dropped are shuffled.
    """
    mark = "row_mark"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    plain = [col(f.name) for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    marked = docs.withColumn(mark, F.xxhash64(*plain))
    key = F.struct(col(id_column).alias("id"), F.col(mark).alias("mark"))
    found = near_duplicates(marked.select(key.alias("key"), col(text_column).alias("text")), "key", "text", width, percent)
    found = store_columns(found.select("doc_id", "n_shingles", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")))
    # Equal rows are told apart by nothing: of those that stay, one is taken.
    kept_id, kept_mark, once = mark + "_id", mark + "_mark", mark + "_once"
    by_key = found.groupBy(F.col("doc_id.id").alias(kept_id), F.col("doc_id.mark").alias(kept_mark)).agg(
        F.first("stays").alias("stays"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"))
    alone = F.col("stays") & ((F.col("copies") == 1) | (F.col("n") == 0))
    name = F.unhex(F.lpad(F.hex(F.xxhash64(kept_id, kept_mark)), 16, "0"))
    by_key = store_columns(by_key.select(kept_id, kept_mark, "stays", alone.alias(once), name.alias("cls")))
    # Few of those that stay have the name's bit of a row that goes or is repeated: only these are looked up,
    # so the texts of rows that go are not shuffled.
    held = _filter_of(by_key.where(~F.col(once)).select("cls"))
    looked_up = store_columns(_among(by_key.where("stays"), held))
    held_too = _filter_of(looked_up.select("cls"))
    named = marked.withColumn(mark + "name", F.unhex(F.lpad(F.hex(F.xxhash64(col(id_column), F.col(mark))), 16, "0")))

    @F.arrow_udf("int")
    def place(names: pa.Array) -> pa.Array:  # only the names leave the JVM
        one, two = _may_contain(held.value, names), _may_contain(held_too.value, names)
        release()
        return pc.add(pc.cast(one, pa.int32()), pc.cast(pc.and_(one, two), pa.int32()))

    def part(wanted: int):
        return named.where(place(F.col(mark + "name")) == F.lit(wanted))

    maybe = part(2).join(looked_up.drop("stays", "cls"), col(id_column).eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)))
    single = maybe.where(F.col(once))
    repeated = maybe.where(~F.col(once)).dropDuplicates([mark, kept_id, kept_mark])
    back = [col(c) for c in docs.columns]
    return part(0).select(*back).unionByName(single.select(*back)).unionByName(repeated.select(*back))
