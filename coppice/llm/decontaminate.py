"""Benchmark decontamination by pigeonhole edit matching.

An item that may contain k errors is split into k + 1 pieces: one of them must
stand in the document unchanged. Exact hits of pieces are found by an automaton
over all pieces and verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.textwork import built, col, map_batches, pick, release, text_slices

#: Characters of items per block; all rows are searched once for each block.
BLOCK_CHARS = 16_000_000
#: One error is allowed for so many characters of an item.
CHARS_PER_ERROR = 25
#: Shorter items must stand without errors, as words of their own; with errors they would stand by chance.
SHORTEST = 40
#: Bytes of text that a task copies at a time.
AT_ONCE = 2_000_000


def normal(text: str | None) -> str:
    """Lower case, single spaces."""
    return " ".join(text.lower().split()) if text else ""


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``pattern`` to any part of ``text`` and that part's first end, if within ``budget``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # the part may begin anywhere: the first row is 0
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if score <= budget and (best is None or score < best[0]):
            best = score, j + 1
            if not score:
                break
    return best


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit of the part goes on outside of it."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (
        end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Pieces:
    """The pieces of a block of items, ready to search."""

    def __init__(self, block: tuple[list[tuple[object, str]], int, int]):
        items, chars_per_error, shortest = block
        self.items = [(key, text, len(text) // chars_per_error) for key, text in items]
        self.exact: set[int] = set()
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            if len(text) < shortest:
                self.exact.add(n)
                budget = 0
            for at, piece in pieces_of(text, budget):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton()
            for piece, where in owners.items():
                self.automaton.add_word(piece, (len(piece), where))
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """Item number, distance and end of the best place of each item that stands in ``text``."""
        found: dict[int, tuple[int, int]] = {}
        windows: dict[int, list[int]] = {}
        if self.automaton:
            for end, (length, where) in self.automaton.iter(text):
                for n, at in where:
                    if n in self.exact:
                        if n not in found and stands_alone(text, end + 1 - length, end + 1):
                            found[n] = 0, end + 1
                        continue
                    windows.setdefault(n, []).append(end + 1 - length - at)
        for n, starts in windows.items():
            _, item, budget = self.items[n]
            done = -1
            for start in sorted(starts):
                if start <= done:  # a window around it has been verified
                    continue
                done = start + budget
                low = max(0, start - budget)
                if hit := myers(item, text[low : start + len(item) + 2 * budget], budget):
                    best = hit[0], low + hit[1]
                    found[n] = min(found.get(n, best), best)
                    if not found[n][0]:
                        break
        return [(n, *v) for n, v in sorted(found.items())]


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_chars: int) -> list[list]:
    """Normalised items in blocks of bounded size, read from Spark one block after the other."""
    items = pick(benchmark, item=item_column, text=text_column).where(F.length("text") > 0)
    block, size = [], 0
    for r in items.toLocalIterator():
        if text := normal(r["text"]):
            if block and size + len(text) > block_chars:
                yield block
                block, size = [], 0
            block.append((r["item"], text))
            size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               item_column: str = "item_id", item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR,
               shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where benchmark items stand in documents, up to one error per ``chars_per_error`` characters.

    Case and white space do not matter. Returns one row per document row and
    item found in it: ``doc_id``, ``item_id``, ``distance`` (smallest edit
    distance to a part of the text) and ``end`` (where the first such part ends
    in the normalised text). Items shorter than ``shortest`` must stand without
    errors and not inside a word. Items go to the executors in blocks of ``block_chars`` characters;
    the whole texts of all documents are searched for each block. Null or empty
    texts and items match nothing; repeated rows and items give rows each;
    other columns are not read. No items or documents give no rows.
    """
    picked = pick(docs, doc_id=id_column, text=text_column)
    kind = picked.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema[item_column].dataType
    schema = f"doc_id {kind}, item_id {item_type.simpleString()}, distance int, end long"
    parts = []
    for items in _blocks(benchmark, item_column, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast((items, chars_per_error, shortest))

        def work(batch, held=held):
            pieces = built(held, Pieces)
            row, hits = [], []
            whole = (t for _, part in text_slices(batch.column(1), AT_ONCE) for t in part)
            for i, text in enumerate(whole):
                if text:
                    for n, distance, end in pieces.find(normal(text.decode("utf-8", "surrogatepass"))):
                        row.append(i)
                        hits.append((pieces.items[n][0], distance, end))
            item_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_type.simpleString())
            yield {"doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                   "item_id": pa.array([h[0] for h in hits], item_kind),
                   "distance": pa.array([h[1] for h in hits], pa.int32()),
                   "end": pa.array([h[2] for h in hits], pa.int64())}

        parts.append(map_batches(picked, work, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
               item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR, shortest: int = SHORTEST,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in which no benchmark item stands, with all their columns as they were.

    Null and empty texts stay; an empty benchmark keeps all rows. Repeated rows
    are decided alike. Only the text leaves the JVM, so other columns may have
    any name and type.
    """
    for items in _blocks(benchmark, item_column, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast((items, chars_per_error, shortest))

        docs = docs.where(_clean(held)(col(text_column)))
    return docs


def _clean(held):
    """The condition that a text holds no item of a broadcast block."""
    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        pieces, keep = built(held, Pieces), []
        for _, part in text_slices(column, AT_ONCE):
            keep += [not (t and pieces.find(normal(t.decode("utf-8", "surrogatepass")))) for t in part]
        release()
        return pa.array(keep, pa.bool_())

    return clean
