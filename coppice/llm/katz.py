"""Scoring texts with a Katz backoff language model.

Every training word is a history and a successor of its own. Bigram counts are
discounted by Good-Turing, and what that frees goes to the unseen successors by
exactly normalised backoff weights. Counts are stored in tables partitioned by
key, and positions are routed to the part that holds their count: a text's
score is that of its single words, plus the backoff weight of every history,
plus what a seen bigram gains over backing off. Words that hold at least one in
``2 ** 20`` of all training tokens are also broadcast with their weights; that
saves routing and changes no score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.textwork import column_slices, map_batches, mixed, pick, squeeze, squeeze_sorted, texts, unsqueeze, unsqueeze_sorted
from coppice.session import store_columns

#: A space cannot stand in a word.
END, BEGIN = b" end", b" begin"
#: Frequent words hold at least one of so many tokens, so there are at most so many.
FREQUENT = 1 << 20
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Bytes of text that a task holds as numbers at a time.
AT_ONCE = 5_000_000
_SMOOTH = 0.1
_SHIFT = np.uint64(21)
#: Set in the number of a word that is not broadcast, and in the key of a pair with such a word.
_TOP = np.uint64(1 << 63)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, ascending; the place of each token among them; how many tokens a text has, its end included.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; only distinct ones become objects.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = split.flatten().dictionary_encode()
    words, borders = coded.dictionary, split.offsets.to_numpy()
    numbers = coded.indices.to_numpy()
    real = (pc.binary_length(words).to_numpy() > 0)[numbers]  # white space at a border leaves an empty word there
    numbers, lengths = numbers[real], np.diff(np.concatenate([[0], np.cumsum(real)])[borders]) + 1
    tokens = np.full(len(numbers) + len(lengths), len(words))
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(lengths) - 1] = False
    tokens[inside] = numbers
    hashes, place = np.unique(_ids([*texts(words), END]), return_inverse=True)
    return hashes, place[tokens], lengths


def _ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | _TOP


def _grouped(numbers: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of numbers under ``below``, ascending, where each begins in their order, how often it occurs, and that order."""
    bits = len(numbers).bit_length()
    if below << bits < 1 << 63:  # sorting values is several times as fast as sorting places
        both = np.sort((numbers << bits) | np.arange(len(numbers)))
        order, numbers = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[starts], starts, np.diff(starts, append=len(numbers)), order


def _pair_keys(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One number for each pair: exact for two broadcast words, else a hash."""
    odd = (before | codes) >= _TOP
    keys = (before << _SHIFT) | codes
    keys[odd] = mixed(mixed(before[odd]) + codes[odd]) | _TOP
    return keys


def _pair_buckets(before: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs stand with their history, unless it is broadcast: those are spread."""
    return _bucket(np.where(before >= _TOP, before, keys), buckets)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(keys: np.ndarray, buckets: int):
    """Each bucket with the places of its keys; ``keys`` ascend, and so do the places."""
    return _split(_bucket(keys, buckets))


def _split(numbers: np.ndarray):
    order = np.argsort(numbers, kind="stable")
    found, starts = np.unique(numbers[order], return_index=True)
    return [(int(b), part) for b, part in zip(found, np.split(order, starts[1:]))]


def _counted(before: np.ndarray, codes: np.ndarray, counts: np.ndarray | None = None):
    """Distinct pairs in ascending order with their summed counts."""
    order = np.lexsort((codes, before))
    before, codes = before[order], codes[order]
    new = np.ones(len(before), bool)
    new[1:] = (before[1:] != before[:-1]) | (codes[1:] != codes[:-1])
    starts = np.flatnonzero(new)
    if counts is None:
        total = np.diff(starts, append=len(before))
    else:
        total = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return before[starts], codes[starts], total.astype(np.int64)


def _tables(rows: DataFrame, buckets: int) -> DataFrame:
    """Words and counts of every batch, added up per bucket and stored: ``bucket``, ``keys``, ``counts``."""

    def count(batch):
        for _, data in column_slices(batch.column(0), AT_ONCE):
            keys, tokens, _ = _tokens(data)
            counts = np.bincount(tokens, minlength=len(keys))
            keys, counts = keys[counts > 0], counts[counts > 0]
            split = _by_bucket(keys, buckets)
            yield {"bucket": pa.array([b for b, _ in split], pa.int64()),
                   "keys": pa.array([squeeze_sorted(keys[at]) for _, at in split], pa.binary()),
                   "counts": pa.array([squeeze(counts[at].astype(np.int64)) for _, at in split], pa.binary())}

    def add(key, table):
        keys = np.concatenate([unsqueeze_sorted(x, np.uint64) for x in table["keys"].to_pylist()])
        counts = np.concatenate([unsqueeze(x) for x in table["counts"].to_pylist()])
        keys, inverse = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, counts)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()),
                         "keys": pa.array([squeeze_sorted(keys)], pa.binary()),
                         "counts": pa.array([squeeze(total)], pa.binary())})

    schema = "bucket long, keys binary, counts binary"
    return store_columns(map_batches(rows, count, schema).groupBy("bucket").applyInArrow(add, schema))


@dataclass(frozen=True)
class Classes:
    """Frequent words (hashes ascend) with their counts, numbered from 1; the next number is the begin.

    All other words have number 0 if they are ``merged``, else their own hash.
    """

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    merged: bool

    @property
    def floor(self) -> float:
        return self.total + _SMOOTH * (self.distinct + 1)

    @property
    def rare(self) -> float:
        """Weight of class 0: its counts and its smoothing, one unknown word included."""
        return self.total - int(self.counts.sum()) + _SMOOTH * (self.distinct - len(self.counts) + 1)

    @property
    def chance(self) -> np.ndarray:
        """Unigram probability of number 0 (all words but the frequent ones) and up; they add up to 1."""
        return np.concatenate([[self.rare], self.counts + _SMOOTH]) / self.floor


class _Coded:
    """Texts as numbers: distinct ``codes`` of words and the begin, ascending, each token's place among them, and its predecessor's."""

    def __init__(self, column: pa.Array, classes: Classes):
        self.hashes, self.tokens, self.lengths = _tokens(column)
        held, begin = classes.hashes, np.uint64(len(classes.hashes) + 1)
        at = np.searchsorted(held, self.hashes)
        fits = at < len(held)
        fits[fits] = held[at[fits]] == self.hashes[fits]
        codes = np.where(fits, (at + 1).astype(np.uint64), np.uint64(0) if classes.merged else self.hashes)
        self.codes, place = np.unique(np.append(codes, begin), return_inverse=True)
        self.places = place[self.tokens]
        self.before = np.empty_like(self.places)
        self.before[1:] = self.places[:-1]
        self.before[np.cumsum(self.lengths) - self.lengths] = place[-1]

    def pairs(self):
        """The distinct pairs in ascending order of (``before``, ``codes``), and for each where its tokens begin, their number and their order."""
        size = len(self.codes)
        found, starts, runs, order = _grouped(self.before * size + self.places, size * size)
        return self.codes[found // size], self.codes[found % size], starts, runs, order


@dataclass(frozen=True)
class Model:
    """``words``, ``pairs`` and ``successors`` (how often the pairs' second words occur) are stored tables.

    ``seen`` and ``unseen`` are weights by number of a frequent history; those
    of other histories follow from the part that holds all their pairs.
    """

    classes: Classes
    words: DataFrame
    pairs: DataFrame
    successors: DataFrame
    buckets: int
    discounts: np.ndarray
    seen: np.ndarray
    unseen: np.ndarray


def good_turing(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0 to ``DISCOUNTED``, from how many bigrams have each count.

    Where the counts of counts are too irregular for a discount between 0 and
    1, half a count is taken off instead.
    """
    n, k = counts_of_counts.astype(float), DISCOUNTED
    out = np.ones(k + 1)
    large = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - large) / (1 - large) if n[r] and large < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def fit(docs: DataFrame, text_column: str = "text", frequent: int | None = None) -> Model:
    """Learn from all texts of ``docs``; null texts count as empty ones.

    Every word is kept. Only if ``frequent`` is given, words that are seen once
    or hold less than one in ``frequent`` tokens share one class, whose members
    are told apart by their own counts.
    """
    spark = docs.sparkSession
    rows = pick(docs, text=text_column)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = _tables(rows, buckets)

    def total(batch):
        counts = [unsqueeze(x) for x in texts(batch.column(2))]
        yield {"n": pa.array([int(c.sum()) for c in counts], pa.int64()), "v": pa.array(map(len, counts), pa.int64())}

    n, v = map_batches(words, total, "n long, v long").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    least = max(2, -(-n // (frequent or FREQUENT)))

    def common(batch):
        for k, c in zip(texts(batch.column(1)), texts(batch.column(2))):
            keys, counts = unsqueeze_sorted(k, np.uint64), unsqueeze(c)
            at = counts >= least
            yield {"keys": pa.array([keys[at].tobytes()], pa.binary()), "counts": pa.array([counts[at].tobytes()], pa.binary())}

    taken = map_batches(words, common, "keys binary, counts binary").collect()
    hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in taken)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in taken)])
    order = np.argsort(hashes)
    classes = Classes(hashes[order], counts[order], n, v, frequent is not None)
    held = spark.sparkContext.broadcast(classes)

    pairs = _pair_tables(rows, held, buckets)

    def counts_of_counts(batch):
        found = [np.bincount(np.minimum(unsqueeze(x), DISCOUNTED + 2), minlength=DISCOUNTED + 3) for x in texts(batch.column(3))]
        yield {"r": pa.array(np.tile(np.arange(DISCOUNTED + 3), len(found)), pa.int64()),
               "n": pa.array(np.concatenate(found), pa.int64())}

    n_r = np.zeros(DISCOUNTED + 3, np.int64)
    for r in map_batches(pairs, counts_of_counts, "r long, n long").groupBy("r").sum("n").collect():
        n_r[r[0]] = r[1]
    discounts = good_turing(n_r)
    successors = _successors(pairs, words, held, discounts, buckets)
    seen, unseen = _frequent_weights(successors, len(hashes) + 2)
    return Model(classes, words, pairs, successors.select("bucket", "others"), buckets, discounts, seen, unseen)


def _pair_tables(rows: DataFrame, held, buckets: int) -> DataFrame:
    """Pairs of every batch, added up per bucket and stored: ``bucket``, ``before``, ``codes``, ``counts``."""
    kinds = (pa.int64(), *[pa.binary()] * 3)
    names = ("bucket", "before", "codes", "counts")

    def count(batch):
        for _, data in column_slices(batch.column(0), AT_ONCE):
            before, codes, _, counts, _ = _Coded(data, held.value).pairs()
            split = _split(_pair_buckets(before, _pair_keys(before, codes), buckets))
            rows = [(b, squeeze_sorted(before[at]), squeeze(codes[at]), squeeze(counts[at])) for b, at in split]
            yield {k: pa.array(x, t) for k, x, t in zip(names, zip(*rows), kinds)}

    def add(key, table):
        before = np.concatenate([unsqueeze_sorted(x, np.uint64) for x in table["before"].to_pylist()])
        codes = np.concatenate([unsqueeze(x, np.uint64) for x in table["codes"].to_pylist()])
        counts = np.concatenate([unsqueeze(x) for x in table["counts"].to_pylist()])
        before, codes, counts = _counted(before, codes, counts)
        row = (key[0].as_py(), squeeze_sorted(before), squeeze(codes), squeeze(counts))
        return pa.table({k: pa.array([x], t) for k, x, t in zip(names, row, kinds)})

    schema = "bucket long, before binary, codes binary, counts binary"
    return store_columns(map_batches(rows, count, schema).groupBy("bucket").applyInArrow(add, schema))


def _pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unsqueeze_sorted(row["before"], np.uint64), unsqueeze(row["codes"], np.uint64), unsqueeze(row["counts"])


def _chances(codes: np.ndarray, others: np.ndarray, classes: Classes) -> np.ndarray:
    """Unigram probability of each number; ``others`` has the counts of those that are not broadcast, in order."""
    out, odd = np.empty(len(codes)), codes >= _TOP
    out[~odd] = classes.chance[codes[~odd].astype(np.int64)]
    out[odd] = (others + _SMOOTH) / classes.floor
    return out


def _sums(before: np.ndarray, counts: np.ndarray, chance: np.ndarray, discounts: np.ndarray):
    """The distinct histories of ascending ``before`` with sums of counts, of discounted counts and of chances."""
    history, start = np.unique(before, return_index=True)
    kept = counts * discounts[np.where(counts <= DISCOUNTED, counts, 0)]
    return history, *(np.add.reduceat(x.astype(float), start) if len(start) else np.zeros(0) for x in (counts, kept, chance))


def _backoff(total: np.ndarray, kept: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a discounted count and an unseen successor are multiplied with; 0 and 1 for no history.

    A history whose counts are all too large for a discount leaves nothing to
    unseen successors; they get one count more.
    """
    met = total > 0
    seen, unseen = np.zeros(len(total)), np.ones(len(total))
    free = 1 - successor
    some = met & (free > 1e-9)
    total = total + (some & (kept >= total))
    seen[some] = 1 / total[some]
    unseen[some] = (1 - kept[some] / total[some]) / free[some]
    every = met & ~some  # every word follows: no text can back off from here
    seen[every] = 1 / kept[every]
    return seen, unseen


def _successors(pairs: DataFrame, words: DataFrame, held, discounts: np.ndarray, buckets: int) -> DataFrame:
    """For each bucket of ``pairs``, stored: counts of second words that are not broadcast, sums by frequent history."""

    def ask(batch):
        for source, codes in zip(batch.column(0).to_pylist(), texts(batch.column(2))):
            codes = unsqueeze(codes, np.uint64)
            wanted = np.unique(codes[codes >= _TOP])
            split = _by_bucket(wanted, buckets)
            yield {"bucket": pa.array([b for b, _ in split], pa.int64()), "source": pa.array([source] * len(split), pa.int64()),
                   "keys": pa.array([squeeze_sorted(wanted[at]) for _, at in split], pa.binary())}

    def answer(key, asked, counted):
        have, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if counted.num_rows:
            have = unsqueeze_sorted(counted["keys"][0].as_py(), np.uint64)
            counts = unsqueeze(counted["counts"][0].as_py())
        found = [squeeze(counts[np.searchsorted(have, unsqueeze_sorted(x, np.uint64))]) for x in asked["keys"].to_pylist()]
        return pa.table({"bucket": asked["source"], "part": pa.array([key[0].as_py()] * len(found), pa.int64()),
                         "counts": pa.array(found, pa.binary())})

    def fill(key, stored, answers):
        if not stored.num_rows:
            raise ValueError("answers for a bucket that asked nothing")
        before, codes, counts = _pairs_of(stored.to_pylist()[0])
        odd = codes >= _TOP
        wanted, place = np.unique(codes[odd], return_inverse=True)
        parts = {x["part"]: x["counts"] for x in answers.to_pylist()}
        others = np.zeros(len(wanted), np.int64)
        for b, at in _by_bucket(wanted, buckets):
            others[at] = unsqueeze(parts[b])
        others = others[place]
        frequent = before < _TOP
        chance = _chances(codes, others, held.value)
        history, *sums = _sums(before[frequent], counts[frequent], chance[frequent], discounts)
        row = {"others": squeeze(others), "history": squeeze_sorted(history)} | dict(zip(_SUMS, (x.tobytes() for x in sums)))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64())} | {k: pa.array([x], pa.binary()) for k, x in row.items()})

    answers = map_batches(pairs, ask, "bucket long, source long, keys binary").groupBy("bucket").cogroup(
        words.groupBy("bucket")).applyInArrow(answer, "bucket long, part long, counts binary")
    return store_columns(pairs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        fill, "bucket long, others binary, history binary, total binary, kept binary, successor binary"))


_SUMS = ("total", "kept", "successor")


def _frequent_weights(stored: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of :func:`_backoff` by number of a frequent history."""
    slice_bits = 14

    def partial(batch):
        for row in pa.Table.from_batches([batch]).to_pylist():
            history = unsqueeze_sorted(row["history"], np.uint64).astype(np.int64)
            sums = {name: np.frombuffer(row[name]) for name in _SUMS}
            for s in np.unique(history >> slice_bits):
                at = (history >> slice_bits) == s
                yield {"part": pa.array([int(s)], pa.int64()), "history": pa.array([squeeze_sorted(history[at])], pa.binary())} | {
                    name: pa.array([x[at].tobytes()], pa.binary()) for name, x in sums.items()}

    def add(key, table):
        low = key[0].as_py() << slice_bits
        out = np.zeros((3, 1 << slice_bits))
        for row in table.sort_by("history").to_pylist():
            at = unsqueeze_sorted(row["history"]) - low
            for x, name in zip(out, _SUMS):
                x[at] += np.frombuffer(row[name])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([out.tobytes()], pa.binary())})

    schema = "part long, history binary, total binary, kept binary, successor binary"
    sums = np.zeros((3, ((size >> slice_bits) + 1) << slice_bits))
    found = map_batches(stored.select("history", *_SUMS), partial, schema)
    for r in found.groupBy("part").applyInArrow(add, "part long, sums binary").toLocalIterator():
        at = r["part"] << slice_bits
        sums[:, at : at + (1 << slice_bits)] = np.frombuffer(r["sums"]).reshape(3, -1)
    return _backoff(*sums[:, :size])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score every whole text, its end included.

    Returns one row per input row: ``doc_id``, ``n_tokens``, ``n_known``
    (tokens that occur in training), ``train_tokens``, ``base_score`` (smoothed
    unigrams) and ``score`` (log10 probability of the text). A null or empty
    text is its end alone. With nothing learned, both scores come from the
    unknown word's share of 1. Repeated rows and null ids give a row each;
    other columns are not read. No rows give no rows.
    """
    spark, buckets = docs.sparkSession, model.buckets
    picked = pick(docs, doc_id=id_column, text=text_column)
    kind = picked.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(model.classes)
    weights = spark.sparkContext.broadcast((model.classes, model.discounts, model.seen, model.unseen))
    with np.errstate(divide="ignore"):
        own = np.log10(np.concatenate([[1.0], model.classes.counts + _SMOOTH]) / model.classes.floor)
        logs = spark.sparkContext.broadcast((own, np.log10(model.unseen)))

    def route(batch):
        own, back = logs.value
        for part, data in column_slices(batch.column(1), AT_ONCE):
            coded = _Coded(data, held.value)
            lengths = coded.lengths
            docs = len(lengths)
            codes, before = coded.codes[coded.places], coded.codes[coded.before]
            doc = np.repeat(np.arange(docs), lengths)
            rare, known = np.flatnonzero((codes == 0) | (codes >= _TOP)), np.flatnonzero((codes > 0) & (codes < _TOP))
            base = np.bincount(doc[known], own[codes[known].astype(np.int64)], docs)
            weighed = np.flatnonzero(before < _TOP)
            ids = batch.column(0)[part.start : part.stop]
            table = pa.table({
                "doc_id": ids, "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.bincount(doc[known], minlength=docs).astype(np.int64)), "base": pa.array(base),
                "score": pa.array(base + np.bincount(doc[weighed], back[before[weighed].astype(np.int64)], docs))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            head = sink.getvalue().to_pybytes()
            # The same rows of the same task give the same name when a task runs again.
            name = xxhash.xxh3_128_digest(head + coded.hashes[coded.tokens].tobytes())
            rows = [(int.from_bytes(name[:4], "little") % buckets, name, docs, head, None, None, None, None)]
            first, second, *groups = coded.pairs()
            pairs = _pair_keys(first, second)
            single, *singles = _grouped(coded.tokens[rare], len(coded.hashes))
            single = coded.hashes[single]
            for alone, keys, (starts, runs, order), owner, home in ((False, pairs, groups, doc, np.where(first >= _TOP, first, pairs)),
                                                                    (True, single, singles, doc[rare], single)):
                at, up = owner[order], np.argsort(keys, kind="stable")
                distinct, starts, runs, home = keys[up], starts[up], runs[up], home[up]
                for b, where in _by_bucket(home, buckets):
                    places = np.repeat(starts[where] - np.cumsum(runs[where]) + runs[where], runs[where])
                    places += np.arange(len(places))
                    rows.append((b, name, docs, None, alone, squeeze_sorted(distinct[where]), squeeze(runs[where].astype(np.int64)),
                                 squeeze(at[places].astype(np.int64))))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), *[pa.binary()] * 3)
            yield {k: pa.array(x, t) for k, x, t in zip(("bucket", "name", "docs", "head", "alone", "keys", "runs", "places"), columns, kinds)}

    def lookup(stored):
        """Keys and logarithms of the bucket: of pairs what they gain, of words their counts and their backoff weights."""
        classes, discounts, seen, unseen = weights.value
        rows = stored.to_pylist()
        none = np.zeros(0, np.uint64), np.zeros(0)
        words, pairs, back = (none[0], np.zeros(0, np.int64)), none, none
        for row in rows:
            if row["keys"] is not None:
                words = unsqueeze_sorted(row["keys"], np.uint64), unsqueeze(row["counts"])
        before = next((r for r in rows if r["before"] is not None), None)
        if before is not None:
            others = unsqueeze(next(r["others"] for r in rows if r["others"] is not None))
            before, codes, counts = _pairs_of(before)
            chance = _chances(codes, others, classes)
            kept = counts * discounts[np.where(counts <= DISCOUNTED, counts, 0)]
            odd = before >= _TOP
            history, *sums = _sums(before[odd], counts[odd], chance[odd], discounts)
            own = _backoff(*sums)
            ratio = np.empty(len(before))
            at = before[~odd].astype(np.int64)
            ratio[~odd] = seen[at] / unseen[at]
            ratio[odd] = (own[0] / own[1])[np.searchsorted(history, before[odd])]
            keys = _pair_keys(before, codes)
            order = np.argsort(keys)
            pairs = keys[order], np.log10(ratio * kept / chance)[order]
            back = history, np.log10(own[1])
        return words, pairs, back

    def found(have, keys, values):
        """The value of each key, 0 for one that is not there."""
        at = np.searchsorted(have, keys)
        met = at < len(have)
        met[met] = have[at[met]] == keys[met]
        out = np.zeros(len(keys), values.dtype)
        out[met] = values[at[met]]
        return out

    def evaluate(key, positions, stored):
        classes = weights.value[0]
        (have, counts), pairs, back = lookup(stored)
        out, name, sums = [], None, None
        for row in positions.sort_by("name").to_pylist():
            if row["head"] is not None:
                out.append((row["name"], row["head"], None))
                continue
            if row["name"] != name:
                if name is not None:
                    out.append((name, None, squeeze(sums.ravel())))
                name, sums = row["name"], np.zeros((3, row["docs"]))
            keys, runs = unsqueeze_sorted(row["keys"], np.uint64), unsqueeze(row["runs"])
            places = unsqueeze(row["places"])
            if row["alone"]:
                r = found(have, keys, counts)
                base = np.log10((r + _SMOOTH) / classes.floor)
                values = (r > 0, base, base + found(back[0], keys, back[1]))
            else:
                values = (0, 0, found(pairs[0], keys, pairs[1]))
            for total, x in zip(sums, values):
                if not np.isscalar(x):
                    total += np.bincount(places, np.repeat(x.astype(float), runs), row["docs"])
        if name is not None:
            out.append((name, None, squeeze(sums.ravel())))
        return pa.table({"name": pa.array([x[0] for x in out], pa.binary()), "head": pa.array([x[1] for x in out], pa.binary()),
                         "sums": pa.array([x[2] for x in out], pa.binary())})

    learned = model.classes.total

    def gather(key, table):
        heads = [x for x in table["head"].to_pylist() if x is not None]
        copies = len(heads)  # equal batches have equal names and equal sums
        head = pa.ipc.open_stream(heads[0]).read_all()
        sums = np.zeros((3, head.num_rows))
        for x in sorted(x for x in table["sums"].to_pylist() if x is not None):
            sums += unsqueeze(x, np.float64).reshape(3, -1)
        sums /= copies
        one = pa.table({
            "doc_id": head["doc_id"], "n_tokens": head["n_tokens"],
            "n_known": pa.array(head["n_known"].to_numpy() + np.rint(sums[0]).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(head.num_rows, learned), pa.int64()),
            "base_score": pa.array(head["base"].to_numpy() + sums[1]), "score": pa.array(head["score"].to_numpy() + sums[2])})
        return pa.concat_tables([one] * copies).combine_chunks()

    routed = map_batches(picked, route, "bucket long, name binary, docs long, head binary, alone boolean, keys binary, runs binary, places binary")
    tables = model.words.unionByName(model.pairs, True).unionByName(model.successors, True)
    parts = routed.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(
        evaluate, "name binary, head binary, sums binary")
    return parts.groupBy("name").applyInArrow(
        gather, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

