"""Language identification with language-bitmask n-gram filters.

Training keeps, for every language, the byte 4-grams that make up at least MIN_SHARE of its grams. One
Bloom filter per language holds them, and the filters are sliced by bit: a slot of the table is the
mask of the languages whose filter has that bit, so two lookups and an AND return all languages that
contain a gram. A text's hits are counted per language, corrected for the false positives that the
fill of a filter implies, and the language with the most decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spendlake.llm.scan import LOWER, buffers, pieces
from spendlake.llm.shared import text_key, without

#: Labelled texts that training takes of one language, in expectation: its rows are drawn by a hash of id and text.
SAMPLE = 4000
#: Labels that are learned, the most frequent ones.
LANGUAGES = 1024
#: A language's filter holds grams of at least this share, so at most 1 / MIN_SHARE of them.
MIN_SHARE = 2e-5
#: Slots of the filter table, a power of two, and hashes of a gram.
SLOT_BITS = 20
HASHES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
UNKNOWN = "und"

_FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint8)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams of all texts in a row as integers, grams before each text and of all).

    A-Z become a-z, other ASCII becomes a blank, runs of blanks become one, and a text starts and ends with one.
    """
    folded = np.insert(_FOLD[data], offsets, 32)
    bounds = offsets + np.arange(len(offsets))
    blank = folded == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    run = np.cumsum(first)
    at_bound = np.zeros(run[-1] + 1, bool)
    at_bound[run[bounds]] = True
    keep = ~blank | first & ~at_bound[run]
    keep[bounds] = True
    folded, bounds = folded[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
    # text i is folded[bounds[i]: bounds[i + 1] + 1]: the blank between two texts belongs to both
    n = len(folded) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    wide = folded.astype(np.uint32)
    out = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3:] << np.uint32(24)
    inside = np.ones(len(folded), bool)
    for d in (1, 2):
        inside[np.maximum(bounds[1:] - d, 0)] = False  # grams that would reach into the next text
    inside = inside[:n]
    return out[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(bounds, n)]


@dataclass(frozen=True)
class Model:
    """languages: the most frequent first. table: (slots, bytes of the mask). false: chance that a filter claims a gram it lacks."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> Model:
        table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 8))), np.uint8)
        false = np.zeros(len(languages))
        for k, own in enumerate(members):
            bit = np.uint8(1 << k % 8)
            for h in HASHES:
                table[_slot(own, h), k // 8] |= bit
            false[k] = ((table[:, k // 8] & bit) > 0).mean() ** len(HASHES)
        return cls(languages, table, false)

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text. The score is the corrected share of grams that the language's filter has."""
        found, bounds = grams(data, offsets)
        texts = len(offsets) - 1
        n = np.diff(bounds)
        share = np.zeros((texts, len(self.languages)))
        at = [_slot(found, h) for h in HASHES]
        for byte in range(self.table.shape[1]):
            column = np.ascontiguousarray(self.table[:, byte])
            masks = column[at[0]]
            for other in at[1:]:
                masks &= column[other]
            for k in range(8 * byte, min(8 * byte + 8, len(self.languages))):
                hits = np.concatenate([[0], np.cumsum(masks >> np.uint8(k % 8) & np.uint8(1), dtype=np.int64)])[bounds]
                share[:, k] = (np.diff(hits) / np.maximum(n, 1) - self.false[k]) / max(1 - self.false[k], 1e-9)
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])[offsets]
        named = np.diff(letters) > 0
        for i in np.flatnonzero(~named & (np.diff(offsets) > 0)):
            named[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
        if not self.languages:
            return [UNKNOWN] * texts, np.zeros(texts)
        share = np.clip(share, 0, 1)
        best = share.argmax(axis=1)
        score = np.where(named, share[np.arange(texts), best], 0)
        return [self.languages[b] if known else UNKNOWN for b, known in zip(best, named)], score


def _slot(found: np.ndarray, h: np.uint32) -> np.ndarray:
    return found * h >> np.uint32(32 - SLOT_BITS)


def train(labelled: DataFrame, sample: int = SAMPLE, min_share: float = MIN_SHARE) -> Model:
    """A model from ``labelled`` (doc_id, text, lang); rows with a null text or label teach nothing.

    Every language is drawn down to ``sample`` texts in expectation; of more labels than LANGUAGES the most frequent are learned. The driver gets the count of
    each of these and at most ``1 / min_share`` grams of each. Without a labelled row the model
    knows no language.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Model.build([], [])
    rates = labelled.sparkSession.createDataFrame([(lang, min(1.0, sample / sizes[lang])) for lang in languages], "__lang string, rate double")
    drawn = labelled.join(F.broadcast(rates), F.col("lang") == F.col("__lang"))  # at most LANGUAGES rows
    drawn = drawn.where(F.shiftrightunsigned(F.xxhash64(text_key("doc_id"), "text"), 11) < F.col("rate") * float(1 << 53))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {lang: k for k, lang in enumerate(languages)}
        for batch in batches:
            langs = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, end, data, offsets in pieces(*buffers(batch.column(1))):
                found, bounds = grams(data, offsets)
                codes, unique = pd.factorize(np.repeat(langs[first:end], np.diff(bounds)) << 32 | found.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(unique >> 32), pa.array(unique & 0xFFFFFFFF), pa.array(np.bincount(codes, minlength=len(unique)))], names=["lang", "gram", "n"])

    counts = drawn.select("lang", "text").mapInArrow(count, "lang bigint, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    kept = counts.withColumn("total", total).where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * min_share)).select("lang", "gram").toArrow()
    of, gram = kept.column("lang").to_numpy(), kept.column("gram").to_numpy().astype(np.uint32)
    return Model.build(languages, [gram[of == k] for k in range(len(languages))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from ``text`` alone.

    A text that is null, empty or without a letter is `und` with score 0; any other text gets a language of
    the model (the most frequent one where no filter has any of its grams), or `und` where the
    model knows none. Columns of ``docs`` named as a result are replaced. No row is lost or moved.
    """
    docs = without(docs, "lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS masks, whatever the input

    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(*buffers(batch.column(place))):
                lang, score = model.value.decide(data, offsets)
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*own.schema.names, "lang_pred", "score"])

    # not a UDF column: a filter on it would be evaluated apart from the column, that is twice
    return docs.mapInArrow(task, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
