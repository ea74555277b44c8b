"""Small helpers shared by the text operators: column access, Arrow batches, words and hashes."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
UPPER = bytes.maketrans(_UPPER.lower(), _UPPER)


def col(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns cannot clash."""
    return df.select(*[col(name).alias(alias) for alias, name in names.items()])


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return pc.cast(column, pa.binary()).to_pylist()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``work`` to every Arrow batch; it yields dictionaries of columns."""

    def run(batches):
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_pydict(columns)
            release()

    return df.mapInArrow(run, schema)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give memory of batches that are done back to the machine.

    An executor has several workers that wait for work while others run, and
    each would else keep the most it ever had.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def split_words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null gives none."""
    return text.translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def id_hash_mod(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(col(name).cast("string").cast("binary")) % modulus


_BUILT: list = []


def built(held, make):
    """``make`` of a broadcast value, kept in this worker until another one is built.

    A worker outlives its stage, so what earlier stages built, caches included,
    would else stay in memory next to it.
    """
    value = held.value
    if not _BUILT or _BUILT[0] is not make or _BUILT[1] is not value:
        _BUILT.clear()
        release()
        _BUILT[:] = make, value, make(value)
    return _BUILT[2]


def column_slices(column: pa.Array, limit: int) -> Iterator[tuple[slice, pa.Array]]:
    """Consecutive slices of a string column of at most ``limit`` bytes, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield slice(first, stop), column.slice(first, stop - first)
        first = stop


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[slice, list[bytes | None]]]:
    """The same slices with their UTF-8 bytes; only one slice is copied at a time."""
    for part, data in column_slices(column, limit):
        yield part, texts(data)


def squeeze(values: np.ndarray) -> bytes:
    """64-bit values in few bytes: equal places of all values stand together, then zstandard."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(data: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unsqueeze_sorted(data: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(unsqueeze(data, kind), dtype=kind)


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver did.

    On a cluster that has no such folder, ship the library with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known])])
