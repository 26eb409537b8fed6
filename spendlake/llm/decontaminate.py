"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of documents. A segment's index row holds its terms (64-bit hashes) and,
for each, the ascending positions of the term in the segment; documents lie GAP positions apart, so no
match crosses them. The index is written once and searched segment by segment, each task on its
own: the test terms are looked up together, and a phrase starts from the positions of its rarest term in
the segment, which the lists of its other terms, shifted by their offsets, then thin out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.scan import LOWER, WORDLIKE, buffers, hashes, pieces, words
from spendlake.llm.shared import scratch, text_key

WINDOW = 10
#: Free positions between documents; a search spans fewer.
GAP = 1 << 10
#: Bytes of text in a segment.
SEGMENT = 2 << 20
#: Bytes of test items that are searched together: what a task holds of them.
BLOCK = 16 << 20

INDEX = "doc_ids array<bigint>, text_keys array<bigint>, n_words binary, terms binary, counts binary, postings binary"
HITS = "array<struct<item_id:string,start:int,end:int>>"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word of all texts in a row, words before each text and of all)."""
    data = LOWER[data]
    starts, ends, before = words(WORDLIKE[data], offsets)
    return hashes(data, starts, ends), before


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) to ``path`` and read it back; null texts have no words."""
    rows = docs.select("doc_id", F.xxhash64(text_key("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("n_words", "terms", "counts", "postings"))])
        for batch in batches:
            for first, end, data, offsets in pieces(*buffers(batch.column(2)), SEGMENT):
                term, before = terms(data, offsets)
                n_words = np.diff(before)
                at = np.arange(len(term)) + np.repeat(np.arange(end - first) * GAP, n_words)
                order = np.argsort(term, kind="stable")
                term = term[order]
                new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                postings = np.diff(at[order].astype("<u4"), prepend=np.uint32(0))
                row = [n_words.astype("<u4"), term[new].astype("<u8"), np.diff(new, append=len(term)).astype("<u4"), postings.astype("<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(k)[first:end].to_pylist()], pa.list_(pa.int64())) for k in (0, 1)] + [pa.array([x.tobytes()], pa.binary()) for x in row], schema=schema)

    rows.mapInArrow(task, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Segment:
    """The positional index of some documents, as read from its row."""

    def __init__(self, n_words: bytes, terms: bytes, counts: bytes, postings: bytes) -> None:
        self.n_words = np.frombuffer(n_words, "<u4").astype(np.int64)
        self.base = np.cumsum(self.n_words) - self.n_words + np.arange(len(self.n_words)) * GAP
        self.terms = np.frombuffer(terms, "<u8")
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.at = np.cumsum(np.frombuffer(postings, "<u4"), dtype=np.uint32).astype(np.int64)

    def look_up(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted term among the segment's, -1 for none."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        k = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[k] == wanted, k, -1)

    def positions(self, k: int) -> np.ndarray:
        return self.at[self.ends[k] - self.counts[k] : self.ends[k]]

    def phrase(self, own: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase of these terms: lists, shifted by their offsets, met from the rarest on."""
        order = np.argsort(self.counts[own], kind="stable")
        start = self.positions(own[order[0]]) - order[0]
        for k in order[1:]:
            if not len(start):
                break
            other = self.positions(own[k])
            found = np.minimum(np.searchsorted(other, start + k), len(other) - 1)
            start = start[other[found] == start + k]
        return start

    def near(self, own: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the shortest runs, of ``within`` words at most, that end in one of the terms and hold all."""
        own = np.unique(own)
        order = own[np.argsort(self.counts[own], kind="stable")]
        anchor = self.positions(order[0])
        ends = anchor
        for k in order[1:]:
            other = self.positions(k)
            after = np.searchsorted(anchor, other)
            close = np.abs(anchor[np.minimum(after, len(anchor) - 1)] - other) < within
            ends = np.union1d(ends, other[close | (np.abs(anchor[np.maximum(after - 1, 0)] - other) < within)])
        start = ends
        for k in order:
            other = self.positions(k)
            last = np.searchsorted(other, ends, side="right") - 1
            start = np.minimum(start, np.where(last >= 0, other[np.maximum(last, 0)], -within))
        fits = ends - start < within
        return start[fits], ends[fits] + 1


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases: ``vocabulary``, the places of their terms in it by length, and the items of each phrase."""

    vocabulary: np.ndarray
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[str | None]]]

    @classmethod
    def of(cls, ids: list[str | None], texts: pa.Array, window: int | None) -> Phrases:
        """All windows of ``window`` words of each item, or the whole item where it is shorter or ``window`` is None."""
        term, before = terms(*buffers(texts))
        vocabulary, place = np.unique(term, return_inverse=True)
        owners: dict[int, dict[bytes, set]] = {}
        for item, a, b in zip(ids, before.tolist(), before[1:].tolist()):
            n = b - a if window is None else min(window, b - a)
            for k in range(a, b - n + 1) if n else ():
                owners.setdefault(n, {}).setdefault(place[k : k + n].astype("<i8").tobytes(), set()).add(item)
        by_length = {n: np.frombuffer(b"".join(of), "<i8").reshape(-1, n) for n, of in owners.items()}
        return cls(vocabulary, by_length, {n: [sorted(x, key=str) for x in of.values()] for n, of in owners.items()})

    def search(self, segment: Segment, slop: int | None) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
        """(start, end, item names, item of each) of all matches in the segment, by position."""
        at = segment.look_up(self.vocabulary)
        starts, ends, names, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}, [np.zeros(0, np.int64)]
        for n, phrases in self.by_length.items():
            own = at[phrases]
            for k in np.flatnonzero((own >= 0).all(axis=1)):
                start, end = (segment.phrase(own[k]), None) if slop is None else segment.near(own[k], n + slop)
                end = start + n if end is None else end
                for item in self.items[n][k] if len(start) else ():
                    starts.append(start)
                    ends.append(end)
                    which.append(np.full(len(start), names.setdefault(item, len(names))))
        return np.concatenate(starts), np.concatenate(ends), list(names), np.concatenate(which)


def _spans(start: np.ndarray, end: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of each item's matches as disjoint spans, in the order of position."""
    order = np.lexsort((end, start, item))
    start, end, item = start[order], end[order], item[order]
    if len(start):
        reach = pd.Series(end).groupby(item).cummax().to_numpy()
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] > reach[:-1])])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
        start, end, item = start[new], reach[last], item[new]
    order = np.lexsort((item, start))
    return start[order], end[order], item[order]


def search(index: DataFrame, items: DataFrame, window: int | None = WINDOW, slop: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_words, hits of every indexed document.

    A hit is a span of words [start, end) in which matches of ``item_id`` (as text) lie side by side or over
    each other. Exact phrases are the windows of ``window`` words of each item, an item that has fewer words
    as a whole; with ``slop`` a match is a run of at most that many words more than the phrase that holds all
    its terms, in any order. ``items`` (item_id, text) go to the tasks in blocks of about ``block`` bytes, one pass
    over the index for each. Items without words, and null texts, match nothing; rows that repeat an
    item_id are one item; the hits of items without an id have a null one.
    """
    if (window or 0) + (slop or 0) >= GAP:
        raise ValueError(f"a search may span fewer than {GAP} words")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        of = Phrases.of(part.column("item_id").to_pylist(), part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()), window)
        hits = _search(index, of, slop)
        found = hits if found is None else found.unionAll(hits)
    if blocks > 1:
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
    return found.drop("segment", "place")


def _search(index: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # of one block of items, whose bytes are bounded

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, keys, *arrays, segment = (c[row] for c in batch.columns)
                own = Segment(*(a.as_py() for a in arrays))
                start, end, names, item = shared.value.search(own, slop)
                start, end, item = _spans(start, end, item)
                doc = np.searchsorted(own.base, start, side="right") - 1
                cuts = np.searchsorted(doc, np.arange(len(own.base) + 1))
                spans = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(item)), pa.array(start - own.base[doc], pa.int32()), pa.array(end - own.base[doc], pa.int32())], ["item_id", "start", "end"])
                n = len(own.base)
                yield pa.RecordBatch.from_arrays([pa.array(ids.values), pa.array(keys.values), pa.array(own.n_words), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), pa.array(np.full(n, segment.as_py())), pa.array(np.arange(n))], names=["doc_id", "text_key", "n_words", "hits", "segment", "place"])

    return index.withColumn("segment", F.monotonically_increasing_id()).mapInArrow(task, f"doc_id bigint, text_key bigint, n_words bigint, hits {HITS}, segment bigint, place bigint")


def words_hit() -> F.Column:
    """The number of words inside any span of ``hits``."""
    return F.expr(
        "aggregate(array_sort(transform(hits, h -> struct(h.start, h.end))), struct(0L AS n, 0 AS reach), "
        "(a, h) -> struct(a.n + greatest(h.end - greatest(h.start, a.reach), 0), greatest(a.reach, h.end)), a -> a.n)"
    )


def items_hit() -> F.Column:
    """The distinct ids of ``hits`` in their order as text."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform("hits", lambda h: h["item_id"]))))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; all columns stay, rows with null texts too."""
    index = build_index(docs, scratch(docs.sparkSession, "postings"))
    path = scratch(docs.sparkSession, "contaminated")
    search(index, items, window).where("size(hits) > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct().write.parquet(path)
    bad = docs.sparkSession.read.schema("__id bigint, __key bigint").parquet(path)  # a written table: Spark knows its size
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_key("text")) == F.col("__key")), "left_anti")
