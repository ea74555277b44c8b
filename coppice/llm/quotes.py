"""Chat formatting by quotation linking.

Quoted passages are parsed with their nesting levels, hashed in a normal form
and joined to the messages that they were taken from. A message answers the
message it quotes, or else the one before it; the answers make conversations,
written in reply order and without the quotes.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.llm.textwork import map_batches, pick, texts
from coppice.session import store_columns

_MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)")
#: A line that only introduces a quote.
_INTRO = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$", re.I)
_WORD = re.compile(r"\w+")


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and its text without the marks."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def passages(text: str | None) -> tuple[str, list[tuple[int, str]], list[str]]:
    """A message's own text, its quoted passages with levels, and its own passages.

    A passage is a run of lines of one level, ended by an empty line. Own
    passages are also whole: a quote may take a paragraph or all of a message.
    """
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    mine: list[str] = []
    run: list[str] = []
    before = 0

    def end() -> None:
        if run:
            (quoted.append((before, "\n".join(run))) if before else mine.append("\n".join(run)))
        run.clear()

    lines = levels(text or "")
    for i, (level, line) in enumerate(lines):
        if level != before or not line.strip():
            end()
            before = level
        if level or not (_INTRO.match(line) and i + 1 < len(lines) and any(x[0] for x in lines[i + 1 : i + 3])):
            if line.strip():
                run.append(line)
            if not level:
                own.append(line)
    end()
    return "\n".join(own).strip(), quoted, mine


def normal_hash(passage: str) -> bytes | None:
    """Hash of the words in lower case; line breaks, white space and punctuation do not matter."""
    words = _WORD.findall(passage.lower())
    return xxhash.xxh3_128_digest(" ".join(words).encode()) if words else None


def _parsed(messages: DataFrame, kinds: str) -> DataFrame:
    def work(batch):
        own, levels_of, hashes, mine = [], [], [], []
        for b in texts(batch.column(3)):
            text, quoted, parts = passages(None if b is None else b.decode("utf-8", "surrogatepass"))
            found = [(n, h) for n, x in quoted if (h := normal_hash(x))]
            own.append(text)
            levels_of.append([n for n, _ in found])
            hashes.append([h for _, h in found])
            lines = [y for x in parts for y in x.split("\n")]
            mine.append(list({h for x in [*parts, *lines, "\n".join(parts)] if (h := normal_hash(x))}))
        yield {"conv_id": batch.column(0), "turn": batch.column(1), "role": batch.column(2), "text": pa.array(own, pa.string()),
               "quote_levels": pa.array(levels_of, pa.list_(pa.int32())), "quotes": pa.array(hashes, pa.list_(pa.binary())),
               "passages": pa.array(mine, pa.list_(pa.binary()))}

    return map_batches(messages, work, f"{kinds}, text string, quote_levels array<int>, quotes array<binary>, passages array<binary>")


def _sources(parsed: DataFrame) -> DataFrame:
    """For each row with quotes, the message it answers: ``row``, ``to_conv``, ``to_turn``."""
    key = F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))
    asked = parsed.where(F.size("quotes") > 0).select("row", key.alias("at"), F.explode(F.arrays_zip("quote_levels", "quotes")).alias("q"))
    asked = store_columns(asked.select("row", "at", F.col("q.quote_levels").alias("level"), F.col("q.quotes").alias("hash")))
    if asked.isEmpty():
        return parsed.sparkSession.createDataFrame([], f"row long, to {parsed.select(key.alias('k')).schema['k'].dataType.simpleString()}")
    wanted = asked.select("hash").distinct()
    said = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(key.alias("at"), F.explode("passages").alias("hash"))
    said = store_columns(said.join(wanted, "hash", "left_semi"))
    # A passage that very many messages contain gives one row for all, and one for each conversation.
    first = said.groupBy("hash").agg(F.min("at").alias("first"))
    inside = said.groupBy("hash", F.col("at.conv").alias("conv")).agg(F.min("at").alias("inside"))
    met = asked.join(first, "hash").withColumn("conv", F.col("at.conv")).join(inside, ["hash", "conv"], "left")
    to = F.when(F.col("inside") < F.col("at"), F.col("inside")).when(F.col("first") < F.col("at"), F.col("first"))
    # The outermost quote is what is answered; of several, the passage said last.
    best = F.min(F.struct("level", (-F.col("to.turn")).alias("late"), "to")).alias("best")
    return met.withColumn("to", to).where(F.col("to").isNotNull()).groupBy("row").agg(best).select("row", F.col("best.to").alias("to"))


def _in_order(parsed: DataFrame) -> DataFrame:
    """Rows sorted by conversation and turn, with ``part``: the piece of the sorted table that holds a row."""
    parts = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parsed.repartitionByRange(parts, "conv_id", "turn", "row").withColumn("part", F.spark_partition_id())
    return store_columns(ordered)


def link_quotes(messages: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                text_column: str = "text") -> DataFrame:
    """Conversations in reply order, without quotes.

    A quoted passage (lines behind ``>``, nested by their number) is looked up
    by its normal form among the paragraphs, lines and whole texts that other
    messages say themselves: first in the same conversation, then in any, and
    only in messages that stand earlier by conversation and turn. A message
    answers the source of its least nested quote, otherwise the message before
    it in its conversation. Returns one row per input row: ``thread_conv`` and
    ``thread_turn`` (the first message of its thread), ``depth`` (answers from
    there), ``conv_id``, ``turn``, ``role``, ``text`` without quotes and lines
    that introduce them, ``parent_conv`` and ``parent_turn`` (null for a first
    message), ``n_quotes``, ``linked`` (answers a quote's source), and
    ``formatted`` (role and text).

    Null or empty texts are messages without words. Rows with a null
    conversation or turn stand alone: they answer nothing and are not
    answered. Repeated rows of one turn follow one another and answer the same
    message. Other columns are not read; no rows give no rows.
    """
    picked = pick(messages, conv_id=conv_column, turn=turn_column, role=role_column, text=text_column)
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role"))
    parsed = store_columns(_parsed(picked, kinds)).withColumn("row", F.monotonically_increasing_id())
    parsed = store_columns(parsed)
    sources = store_columns(_sources(parsed))
    nodes = parsed.select("row", "conv_id", "turn").join(sources, "row", "left")
    placed = _in_order(nodes)
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    # The turn before: inside a piece of the sorted table by a window, across pieces from what ends the earlier ones.
    turns = placed.where(whole).groupBy("part", "conv_id", "turn").agg(
        F.min(F.struct("row", "to")).alias("x")).select("part", "conv_id", "turn", "x.to")
    turns = turns.groupBy("conv_id", "turn").agg(F.min("part").alias("part"), F.first("to", ignorenulls=True).alias("to"))
    ends = turns.groupBy("part", "conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    piece = Window.partitionBy("conv_id").orderBy("part")  # a row per piece, not per message
    carried = ends.withColumn("carry", F.lag("last").over(piece)).select("part", "conv_id", "carry")
    local = Window.partitionBy("part", "conv_id").orderBy("turn")
    before = turns.withColumn("lag", F.lag("turn").over(local)).join(carried, ["part", "conv_id"])
    before = before.select("conv_id", "turn", F.coalesce("lag", "carry").alias("prev"), "to")
    key = lambda conv, turn: F.when(F.col(turn).isNotNull(), F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn")))
    parent = F.coalesce("to", key("conv_id", "prev"))
    tree = store_columns(before.select(key("conv_id", "turn").alias("node"), parent.alias("parent"), F.col("to").isNotNull().alias("linked")))
    placed_in = _threads(tree)
    out = parsed.withColumn("node", F.when(whole, F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))))
    out = out.join(placed_in, "node", "left").join(tree, "node", "left")
    return out.select(
        F.coalesce(F.col("top.conv"), F.col("conv_id")).alias("thread_conv"), F.coalesce(F.col("top.turn"), F.col("turn")).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "conv_id", "turn", "role", "text",
        F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("linked", F.lit(False)).alias("linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("formatted"))


def _threads(tree: DataFrame) -> DataFrame:
    """``node``, ``top`` and ``depth``: parents are followed in steps that double, by the nodes not at the top yet."""
    far = store_columns(tree.select("node", F.coalesce("parent", "node").alias("top"), F.col("parent").isNotNull().cast("long").alias("depth")))
    done, climbing = far.where("depth = 0"), far.where("depth > 0")
    while True:
        # A node whose top is a first message is done; the others take their top's steps as well.
        up = climbing.unionByName(done.where("depth > 0")).select(F.col("node").alias("via"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = store_columns(climbing.join(up, F.col("top") == F.col("via"), "left").select(
            "node", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved")))
        done = done.unionByName(step.where("not moved").drop("moved"))
        climbing = step.where("moved").drop("moved")
        if climbing.isEmpty():
            return done
