"""Language identification by compression.

Each language has a dictionary of raw text. A text is compressed with every
dictionary, block by block, and belongs to the language whose dictionary makes
it smallest; a narrow margin rejects it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.llm.textwork import built, col, map_batches, pick, release, text_slices

_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: The language of a text without letters.
UNKNOWN = "und"
#: Bytes of text that a task copies at a time.
AT_ONCE = 2_000_000


@dataclass(frozen=True)
class LanguageParams:
    """``sample_rows`` texts per language, of at most ``sample_bytes`` each, make up its dictionary.

    These two bound what is fitted on, whatever the size of the input. Texts
    are compressed in blocks of ``block`` bytes so that the dictionary stays
    within reach. ``margin`` is the smallest score that is not rejected.
    """

    sample_rows: int = 60
    sample_bytes: int = 1024
    block: int = 2048
    margin: float = 0.01


def letters_only(text: str) -> bytes:
    """Lower case, with one space for everything between letters: symbols say nothing of a language."""
    return (" " + _NO_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class LanguageModel:
    """``dictionaries`` by language, the most frequent language first."""

    dictionaries: dict[str, bytes]
    params: LanguageParams = field(default_factory=LanguageParams)


def fit_languages(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                  params: LanguageParams | None = None) -> LanguageModel:
    """Take a dictionary for each language from labelled rows.

    The sample is the rows with the smallest hashes of id and text, so it does
    not depend on how the rows are stored. Rows with a null language or a null
    or empty text are left out; no usable row gives a model without languages.
    """
    params = params or LanguageParams()
    rows = pick(labelled, id=id_column, text=text_column, lang=lang_column)
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", "text", F.xxhash64(F.col("id").cast("string"), "text").alias("place"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    # The ranking carries hashes only; each task passes on sample_rows rows of a language at most.
    chosen = rows.select("lang", "place").withColumn("rank", rank).where(F.col("rank") <= params.sample_rows)
    last = {r["lang"]: r["place"] for r in chosen.groupBy("lang").agg(F.max("place").alias("place")).collect()}
    if not last:
        return LanguageModel({}, params)
    bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    sample = rows.where(F.col("place") <= bound[F.col("lang")]).dropDuplicates(["lang", "place"])
    taken = sample.select("lang", "place", F.substring("text", 1, params.sample_bytes).alias("text")).collect()
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in taken:
        found.setdefault(r["lang"], []).append((r["place"], letters_only(r["text"])))
    order = sorted(found, key=lambda k: (-counts[k], k))
    return LanguageModel({k: b"".join(t for _, t in sorted(found[k])) for k in order}, params)


class _Compressors:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.by_language = []
        # Short matches and a lazy search suit small blocks of prose.
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=4,
            write_content_size=False, write_dict_id=False)
        for lang, content in model.dictionaries.items():
            held = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            self.by_language.append((lang, zstandard.ZstdCompressor(compression_params=how, dict_data=held)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how much smaller it makes the text than the next one, as a share."""
        if not text or not self.by_language or not _LETTER.search(text):
            return UNKNOWN, 0.0
        data, block = letters_only(text), self.model.params.block
        parts = [data[i : i + block] for i in range(0, len(data), block)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), i) for i, (_, c) in enumerate(self.by_language))
        best = self.by_language[sizes[0][1]][0]
        if len(sizes) == 1:
            return best, 1.0
        return best, 1.0 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Predict the language of every whole text from the text alone.

    Returns one row per input row: ``doc_id``, ``lang_pred``, ``score`` (0 to 1,
    the margin between the two smallest sizes) and ``accepted`` (the score
    reaches the margin). A null text, a text without letters, or a model
    without languages gives ``und`` with score 0, not accepted. Equal sizes go
    to the language with more learned rows. Repeated rows and null ids give a
    row each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        ready = built(held, _Compressors)
        found = [ready.predict(None if b is None else b.decode("utf-8", "surrogatepass"))
                 for _, part in text_slices(batch.column(1), AT_ONCE) for b in part]
        yield {"doc_id": batch.column(0), "lang_pred": pa.array([x[0] for x in found], pa.string()),
               "score": pa.array([x[1] for x in found], pa.float64()),
               "accepted": pa.array([x[0] != UNKNOWN and x[1] >= model.params.margin for x in found], pa.bool_())}

    picked = pick(docs, doc_id=id_column, text=text_column)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_batches(picked, work, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The rows whose language is accepted, with all their columns as they were.

    Rows with a null or empty text or one without letters go, and all rows if
    the model has no language. Repeated rows are decided alike. Only the text
    leaves the JVM, so other columns may have any name and type.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(column: pa.Array) -> pa.Array:
        ready, keep = built(held, _Compressors), []
        for _, part in text_slices(column, AT_ONCE):
            for b in part:
                lang, score = ready.predict(None if b is None else b.decode("utf-8", "surrogatepass"))
                keep.append(lang != UNKNOWN and score >= model.params.margin)
        release()
        return pa.array(keep, pa.bool_())

    return docs.where(accepted(col(text_column)))
