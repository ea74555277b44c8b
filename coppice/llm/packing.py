"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A piece is placed in the open sequence for which the sum, over all gaps, of
the squared number of open sequences with that gap becomes smallest. Equal
gaps are thus avoided, which keeps a partner for every length at hand.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.textwork import UPPER, built, column_slices, map_batches, pick
from coppice.session import store_columns

#: Pieces that one task packs together: a bound on its memory, not on the work.
BLOCK_TOKENS, BLOCK_PIECES = 4096 * 8192, 500_000
#: Bytes of text that are tokenised in one call; only its distinct chunks stand in memory as objects.
AT_ONCE = 2_000_000
#: Chunks that the tokenizer gets in one call; what it returns of each takes about a kilobyte.
CHUNKS_AT_ONCE = 8_000
PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids, as little-endian bytes, of chunks between white space, remembered up to a bound.

    The tokenizer finds its added tokens in the text as it stands. In what is
    between them it drops white space, never joins what it separates and
    ignores the case of letters, so those ids are those of its chunks in order.
    """

    #: Chunks that are remembered, as Arrow arrays; beyond it, those met since it was last reached stay, half of it at most.
    LIMIT = 600_000
    _STOP = {"pattern": r"([a-z])([.,])([\x20\t-\r]|$)", "replacement": r"\1 \2\3"}

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Longer tokens first, as where several begin at one place.
        added = sorted(((t.content.encode(), i) for i, t in self.tokenizer.get_added_tokens_decoder().items()), key=lambda x: (-len(x[0]), x))
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added}
        self.at_added = re.compile(b"(" + b"|".join(re.escape(token) for token, _ in added) + b")") if added else None
        self.chunks, self.found = pa.array([], pa.binary()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, bool)

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        out, plain, other = {}, [], []
        for c in chunks:
            # Another spelling of an added token is no such token, so it must not become one by lower-casing.
            text = (c.translate(UPPER) if self.at_added and self.at_added.search(c) else c).decode("utf-8", "surrogatepass")
            (plain if text.isalpha() else other).append((c, text))
        if plain:  # each is one word of the tokenizer, so its last token is the only one that ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in plain)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            if len(cuts) == len(plain) + 1 and cuts[-1] == len(data):
                out.update((c, data[a:b]) for (c, _), a, b in zip(plain, cuts, cuts[1:]))
            else:
                other += plain
        if other:
            found = self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)
            out.update((c, np.array(e.ids, "<u4").tobytes()) for (c, _), e in zip(other, found))
        return [out[c] for c in chunks]

    def ids(self, batch: pa.Array | list[bytes | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        whole = pc.fill_null(pa.array(batch, pa.binary()) if isinstance(batch, list) else pc.cast(batch, pa.binary()), b"")
        # Plain parts and, between each two of them, an added token.
        split = {}
        if self.at_added:
            found = [pc.match_substring(whole, token) for token in self.added]
            split = {i: self.at_added.split(whole[i].as_py()) for i in np.flatnonzero(np.any([x.to_numpy(zero_copy_only=False) for x in found], axis=0))}
        if not split:
            return self._plain(whole)
        at, parts = 0, []
        for i, x in split.items():
            parts += [*whole[at:i].to_pylist(), *x[::2]]
            at = i + 1
        ids = iter(self._plain(pa.array([*parts, *whole[at:].to_pylist()], pa.binary())))
        return [next(ids) + b"".join(self.added[token] + next(ids) for token in split.get(i, ())[1::2]) for i in range(len(whole))]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text without added tokens."""
        lower = pc.replace_substring_regex(pc.ascii_lower(texts.view(pa.string())), **self._STOP)
        split = pc.ascii_split_whitespace(lower)
        chunks = split.flatten().dictionary_encode()
        distinct = pc.cast(chunks.dictionary, pa.binary())
        at = pc.index_in(distinct, value_set=self.chunks)
        new = distinct.filter(at.is_null())
        at, fresh = at.fill_null(-1).to_numpy(zero_copy_only=False).copy(), len(self.chunks)
        at[at < 0] = np.arange(fresh, fresh + len(new))
        for first in range(0, len(new), CHUNKS_AT_ONCE):
            found = self._encode(new[first : first + CHUNKS_AT_ONCE].to_pylist())
            self.found = pa.concat_arrays([self.found, pa.array(found, pa.large_binary())])
        self.chunks = pa.concat_arrays([self.chunks, new])
        self.met = np.append(self.met, np.ones(len(new), bool))
        self.met[at] = True
        ids = self.found.take(pa.array(at).take(chunks.indices))
        if len(self.chunks) > self.LIMIT:
            stay = pa.array(np.flatnonzero(self.met)[-(self.LIMIT // 2) :])
            self.chunks, self.found, self.met = self.chunks.take(stay), self.found.take(stay), np.zeros(len(stay), bool)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
               id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise whole texts, append ``end_id`` and cut what is longer than ``capacity``.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``. The tokenizer file is read by the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def work(batch):
        words = built(held, WordIds)
        row, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32")}
        for texts_of, data in column_slices(batch.column(1), AT_ONCE):
            for i, ids in enumerate(words.ids(data), texts_of.start):
                ids += end
                for n, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    out["piece"].append(n)
                    out["start"].append(at)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
        yield {"doc_id": batch.column(0).take(pa.array(row, pa.int64()))} | {
            k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()}

    picked = pick(docs, doc_id=id_column, text=text_column)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_batches(picked, work, f"doc_id {kind}, {PIECE_COLUMNS}")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed from the longest on.

    With N(g) open bins of gap g, putting length l into a bin of gap g changes
    the sum of squares by 2 (N(g-l) - N(g) + 1), where full bins do not count.
    Ties go to the smallest gap, and to an open bin before a new one.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    total = 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        have = count[length:capacity]  # gaps that fit, in bins that are open
        change = 2 * (count[: capacity - length] - have + 1)
        if len(change):
            change[0] = 1 - 2 * have[0]  # the bin becomes full
            change[have == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
        fresh = 2 * int(count[capacity - length]) + 1 if length < capacity else 0
        if len(change) and have[best] and change[best] <= fresh:
            gap = best + length
            b = opened[gap].pop()
            count[gap] -= 1
        else:
            gap, b, total = capacity, total, total + 1
        bins[i], offsets[i] = b, capacity - gap
        rest = gap - length
        if rest:
            opened[rest].append(b)
            count[rest] += 1
    return bins, offsets


def place_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``; ``pieces`` must be stored, not recomputed.

    Pieces are dealt to blocks by a hash of their row, so copies do not meet in
    one block; each block is packed by one task. What remains in sequences that
    are not nearly full is dealt anew to fewer blocks, until one block is left.
    """
    packed, level = [], 0
    rest = pieces.withColumn("row", F.monotonically_increasing_id())
    while True:
        size = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
        blocks = max(-(-size[0] // BLOCK_TOKENS), -(-size[1] // BLOCK_PIECES), 1)
        done = _pack_blocks(rest, capacity, blocks, level)
        if blocks == 1 or level == 3:
            packed.append(done.drop("fill", "row"))
            break
        done = store_columns(done)
        packed.append(done.where(F.col("fill") >= capacity - capacity // 64).drop("fill", "row"))
        rest = done.where(F.col("fill") < capacity - capacity // 64).drop("fill", "sequence_id", "offset")
        level += 1
    result = packed[0]
    for more in packed[1:]:
        result = result.unionByName(more)
    return result


def _pack_blocks(rows: DataFrame, capacity: int, blocks: int, level: int) -> DataFrame:
    def pack(key, table):
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)[bins].astype(np.int64)
        number = ((level * blocks + key[0].as_py()) << 32) + bins if level == 0 else (
            -((level << 58) + (key[0].as_py() << 32) + bins + 1))
        table = table.drop_columns(["block"])
        for name, values in (("sequence_id", number), ("offset", offsets), ("fill", fill)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, f"{schema}, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id``, ``piece`` (from 0), ``start``,
    ``length``, ``ids_crc32`` (of the unsigned little-endian ids),
    ``sequence_id`` and ``offset``, gapless from 0 within a sequence. Only
    documents longer than a sequence are cut. A null or empty text is its end
    token alone. Repeated rows and null ids are packed like any other; other
    columns are not read. No rows give no sequences.
    """
    pieces = store_columns(cut_pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column))
    return place_pieces(pieces, capacity)
