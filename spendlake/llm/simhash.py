"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit for each position that is set in over half of its shingles' hashes. Of every distinct
fingerprint a row of Hamming distances to many reference fingerprints is computed once. By the triangle inequality two
fingerprints within LIMIT bits differ by LIMIT at most in each of them, so pairs are discarded by the largest difference of
their rows, and only what is left is compared bit by bit.

The same rows tell which pairs meet. The references come in families: a random one, and its copies with all bits of one
of several blocks flipped. The distance to a copy less that to the first is the block's length less twice the distance
inside the block: a coordinate of that block alone. Two fingerprints within LIMIT bits have at least two of LIMIT + 2 blocks
without a difference, and there all coordinates agree. So a cell is two blocks and their coordinates in all families, and pairs meet in a cell.
In a cell, fingerprints run in the order of their first pivot distance, and the scan of one ends where that distance is LIMIT farther.
A task keeps a spanning forest of its links, not the links.

``deduplicate`` takes wider fingerprints, farther apart, as candidates only, in cells of one block, and exact Jaccard of the shingles
decides. The candidates of spanning forests are judged first; where some fail, all candidates between the parts into which their forest falls are judged,
inside the tasks that find them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from spendlake.llm.scan import LOWER, SPACE, buffers, hashes, pieces, words
from spendlake.llm.shared import Forest, components, sieve, stored, text_key, without

SHINGLE = 4
LIMIT = 4
SEED = 42
#: Families of references; a family is a fingerprint and a copy of it for each block.
FAMILIES = 8
#: Fingerprints of a cell that are compared in one task; a larger cell is cut into pairs of parts.
CELL = 4096
#: Pairs that a task holds before it makes a forest of them.
PAIRS = 1 << 16
#: Hashes whose bits are summed together.
BATCH = 1 << 15
#: For ``deduplicate``: words of a shingle and likeness of near copies; 64-bit words of a fingerprint, and blocks of so many bits of which one agrees.
#: At a likeness of 0.8 a pair agrees in one of the blocks with a chance of 0.94.
NEAR_SHINGLE, NEAR, NEAR_WORDS, NEAR_BLOCKS, NEAR_BITS = 5, 0.8, 6, 27, 14
#: Bits in which candidates differ at most: at a likeness of 0.8, 58 of 384, give or take 7.
NEAR_LIMIT = 76
#: Bytes of a shingle's hash where sets are compared: of two texts of 1,000 shingles, two share a hash with a chance of 4e-9.
HASH = 6
#: Bytes of shingle sets in a part of a torn group, and bits of a set's parity.
PART, PARITY = 32 << 20, 1024
#: Candidates that a task judges together.
JUDGED = 1 << 12
#: Shingles whose bits are summed in single bytes.
RUN = 255
_ODD = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 62, NEAR_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a lower-cased text, as a signed 64-bit integer; 0 for one without words."""
    import xxhash

    found = text.split()
    if not found:
        return 0
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    last = max(1, len(found) - shingle + 1)
    joined = b" ".join(found)
    parts = (xxhash.xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts[:last], ends[min(shingle, len(found)) - 1 :]))
    ones = np.zeros(64, np.int64)
    while got := b"".join(itertools.islice(parts, BATCH)):
        ones += np.add.reduce(np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > last).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints of whole texts; a null or a text without words gives 0."""
    out = []
    for _, _, data, offsets in pieces(*buffers(pa.array(texts, pa.large_string()))):
        raw, bounds = LOWER[data].tobytes(), offsets.tolist()
        out += [fingerprint(raw[a:b]) for a, b in itertools.pairwise(bounds)]
    return pd.Series(out, dtype="int64")


def shingles(texts: pa.Array, shingle: int = NEAR_SHINGLE) -> Iterator[np.ndarray]:
    """Of each text the 64-bit hashes of its shingles of ``shingle`` words, repeats included; of fewer words, the sequence of them is the one shingle."""
    for _, _, data, offsets in pieces(*buffers(texts)):
        low = LOWER[data]
        starts, ends, before = words(~SPACE[low], offsets)
        own = hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        for a, b in itertools.pairwise(before.tolist()):
            size = min(shingle, b - a)
            mixed = np.zeros(b - a - size + 1 if size else 0, np.uint64)
            for k in range(size):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[a + k : b - size + 1 + k]
            yield mixed


def wide_fingerprint(hashed: np.ndarray) -> np.ndarray:
    """NEAR_WORDS 64-bit words that tell which bits are set in over half of the hashes drawn from each of ``hashed``; all zero for none."""
    ones = np.zeros(64 * NEAR_WORDS, np.int64)
    for at in range(0, len(hashed), RUN):
        drawn = hashed[at : at + RUN, None] * _ODD
        drawn ^= drawn >> np.uint64(31)
        drawn *= np.uint64(0x94D049BB133111EB)
        drawn ^= drawn >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(drawn.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashed)).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def wide_fingerprints(texts: pd.Series) -> pd.Series:
    """Wide fingerprints of whole texts; a null or a text without words gives zeros."""
    return pd.Series([wide_fingerprint(x) for x in shingles(pa.array(texts, pa.large_string()))], dtype=object)


@dataclass(frozen=True)
class Pivots:
    """Families of reference fingerprints: a random one, and after it a copy with the bits of one of the blocks flipped, for each."""

    blocks: tuple[tuple[int, ...], ...]  # the 64-bit words of each block's bits
    agree: int = 2  # blocks of a cell

    @classmethod
    def even(cls, n: int) -> Pivots:
        """``n`` blocks of one word."""
        cuts = np.linspace(0, 64, n + 1).astype(int).tolist()
        return cls(tuple(((1 << b) - (1 << a),) for a, b in itertools.pairwise(cuts)))

    @classmethod
    def narrow(cls, n: int, bits: int, words: int, agree: int) -> Pivots:
        """``n`` blocks of ``bits`` bits, ``agree`` of which make a cell; together they may leave bits out."""
        masks = [((1 << bits) - 1) << bits * k for k in range(n)]
        return cls(tuple(tuple(m >> 64 * w & (1 << 64) - 1 for w in range(words)) for m in masks), agree)

    def references(self) -> np.ndarray:
        """(family, 1 + blocks, words)"""
        words = len(self.blocks[0])
        heads = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, (FAMILIES, 1, words), dtype=np.uint64)
        return heads ^ np.array([(0,) * words, *self.blocks], np.uint64)

    def table(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprint, family, 1 + blocks): Hamming distances to all references of the rows of ``fp``."""
        out = np.zeros((len(fp), FAMILIES, 1 + len(self.blocks)), np.int16)
        references = self.references()
        for w in range(fp.shape[1]):
            out += np.bitwise_count(fp[:, w].view(np.uint64)[:, None, None] ^ references[None, :, :, w])
        return out

    def cells(self, fp: np.ndarray) -> Iterator[np.ndarray]:
        """For each ``agree`` blocks a hash of them and of their coordinates in all families."""
        table = self.table(fp).astype(np.int64)
        coordinates = table[:, :, 1:] - table[:, :, :1]
        odd = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, coordinates.shape[1:]) * 2 + 1
        of_block = (coordinates * odd).sum(axis=1) + np.arange(coordinates.shape[2])
        of_block = (of_block ^ of_block >> 29) * np.int64(0x1B873593CC9E2D51)
        for chosen in itertools.combinations(range(of_block.shape[1]), self.agree):
            key = np.zeros(len(fp), np.int64)
            for block in chosen:
                key = ((key ^ key >> 31) * 3 + of_block[:, block]) * np.int64(0x2545F4914F6CDD1D)
            yield key


def spanning(forest: Forest, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (a, b) that join the parts of ``forest`` as all of them do, and no more than needed; earlier pairs go first."""
    chosen = []
    while True:
        x, y = forest.label[a], forest.label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        first = np.unique(np.maximum(x, y), return_index=True)[1]  # each part takes one pair that leads to an earlier part
        chosen.append((a[first], b[first]))
        forest.union(a[first], b[first])
    return tuple(map(np.concatenate, zip(*chosen))) if chosen else (a[:0], b[:0])


def _candidates(group: np.ndarray, meet: np.ndarray, fp: np.ndarray, pivots: Pivots, label: np.ndarray, limit: int, forest: Forest | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, bits): pairs of rows of one group and of two labels within ``limit`` bits; ``meet`` are codes of which those of a pair must differ, unless they are -1.

    Pairs that ``forest`` has joined by then are passed over, so that a dense group costs little once it is connected.

    Distances to references spread by about the root of the fingerprint's bits: a wider limit discards next to nothing by them, and bits are compared at once.
    """
    if not len(fp):
        return
    discards = limit * limit < 64 * fp.shape[1]
    head = np.bitwise_count(fp.view(np.uint64) ^ pivots.references()[0, 0]).sum(axis=1, dtype=np.int16)
    order = np.lexsort((head, group))
    group, meet, label, fp, head = group[order], meet[order], label[order], fp[order].view(np.uint64), head[order]
    table = pivots.table(fp.view(np.int64)).reshape(len(fp), -1) if discards else None
    a, step, heads = np.arange(len(fp)), 1, range(1 + len(pivots.blocks), FAMILIES * (1 + len(pivots.blocks)), 1 + len(pivots.blocks))
    while True:
        a = a[a + step < len(fp)]
        b = a + step
        a = a[(group[a] == group[b]) & (head[b] - head[a] <= limit)]
        if not len(a):
            return
        x = a[(meet[a] != meet[a + step]) | (meet[a] == -1)]
        if forest is not None:
            x = x[forest.label[order[x]] != forest.label[order[x + step]]]
        x = x[label[x] != label[x + step]]
        if discards:
            for column in heads:
                x = x[np.abs(table[x, column] - table[x + step, column]) <= limit]
            x = x[np.abs(table[x] - table[x + step]).max(axis=1, initial=0) <= limit]
        bits = np.bitwise_count(fp[x] ^ fp[x + step]).sum(axis=1, dtype=np.int16)
        near = bits <= limit
        if near.any():
            yield order[x[near]], order[x[near] + step], bits[near]
        step += 1


def links(nodes: DataFrame, limit: int = LIMIT, pivots: Pivots | None = None, cell: int = CELL, forests: bool = True) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, fp, label) that meet within ``limit`` bits; those of equal labels are left out.

    ``fp`` is an array of 64-bit words. With blocks that cover all bits, limit + 2 or more of them, all pairs within ``limit`` meet. With ``forests``
    a task returns only pairs that connect its nodes as all of them do. A pair may come from several cells.
    """
    pivots = pivots or Pivots.even(limit + 2)
    words = len(pivots.blocks[0])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = batch.slice(at, BATCH)
                fp = rows.column("fp").flatten().to_numpy().reshape(-1, words)
                for key in pivots.cells(fp):
                    yield rows, fp, key

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, key in cells(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["__key"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fp, key in cells(batches):
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(fp), [None, pa.py_buffer(fp.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), rows.column("node"), packed, rows.column("label")], names=["key", "node", "fp", "label"])

    rows = nodes.select("node", "fp", "label").mapInArrow(deal, "key bigint, node bigint, fp binary, label bigint")
    # a cell over the limit: every fingerprint is in one part and meets all parts, two in a task
    large = nodes.select("fp").mapInArrow(keys_only, "__key bigint").groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = stored(large, "large")
    rows = rows.join(large, F.col("key") == F.col("__key"), "left")
    rows = rows.withColumn("parts", F.coalesce(F.ceil(F.col("n") / cell).cast("int"), F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label", "fp")
    keys = ["key", "low", "high"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def found(low: np.ndarray, high: np.ndarray, part: np.ndarray, group: np.ndarray, node: np.ndarray, label: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.append(True, (group[1:] != group[:-1]))
        alone = np.flatnonzero(first & np.append(first[1:], True))
        some = np.ones(len(group), bool)
        some[alone] = False
        low, high, part, group, node, label, fp = (x[some] for x in (low, high, part, group, node, label, fp))
        forest, held, n = Forest(len(node)), [], 0

        def out() -> pa.RecordBatch:
            a, b, bits = map(np.concatenate, zip(*held))
            if forests:  # near ones first, so that a forest is made of likely pairs
                order = np.argsort(bits, kind="stable")
                a, b = spanning(forest, a[order], b[order])
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for a, b, bits in _candidates(group, np.where(low == high, -1, part), fp, pivots, label, limit, forest if forests else None):
            held.append((a, b, bits))
            n += len(a)
            if n > PAIRS:
                yield out()
                held.clear()
                n = 0
        if held:
            yield out()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]] + [buffers(batch.column(6))[0].copy().view(np.int64).reshape(-1, words)]
                rest = [np.concatenate(x) for x in zip(rest, new)] if rest else new
            if not rest or not len(rest[0]):
                continue
            key, low, high, part, node, label, fp = rest
            begins = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            end = len(key) if batch is None else int(np.flatnonzero(begins)[-1])  # the last cell may go on in the next batch
            if end:
                yield from found(*(x[:end] for x in (low, high, part, np.cumsum(begins), node, label, fp)))
            rest = [x[end:] for x in rest]

    return rows.mapInArrow(task, "a bigint, b bigint")


def groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of ``limit`` bits reach, null where none of those rows
    has a doc_id. Texts without words, and null texts, have fingerprint 0 and link like any other.
    Rows that repeat a doc_id or a text are rows of their own. An empty table gives an empty result.
    Equal fingerprints are one node, so a group of copies is joined by one aggregation.
    """
    prints = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("fp"), F.col("fp").alias("label")), limit))
    nodes = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    nodes = stored(nodes, "nodes")
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "component").select(F.col("fp").alias("node"), "component_id")
    return prints.join(named, prints["fp"] == named["node"]).drop("node")


def fingerprint_hex() -> F.Column:
    return F.lpad(F.lower(F.hex("fp")), 16, "0")


def packed_set(hashed: np.ndarray) -> bytes:
    """The different ones of 64-bit hashes by their upper HASH bytes, in order."""
    return np.unique(hashed >> np.uint64(64 - 8 * HASH)).view(np.uint8).reshape(-1, 8)[:, :HASH].tobytes()


def unpacked_set(packed: pa.Buffer) -> np.ndarray:
    out = np.zeros((packed.size // HASH, 8), np.uint8)
    out[:, :HASH] = np.frombuffer(packed, np.uint8).reshape(-1, HASH)
    return out.view(np.uint64).ravel()


def shingle_sets(texts: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text): the sorted 48-bit hashes of a text's different shingles, HASH bytes each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed_set(x) for x in shingles(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(sets, "node bigint, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, as sorted arrays, have Jaccard ``least``."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def judged(edges: DataFrame, sets: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, near) of ``edges`` (a, b): whether the shingles of two nodes of ``sets`` (node, shingles) have Jaccard ``least``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(unpacked_set(x.as_buffer()), unpacked_set(y.as_buffer()), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near, pa.bool_())], names=["a", "b", "near"])

    both = edges.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(judge, "a bigint, b bigint, near boolean"), "judged")


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """(set, words): for each of PARITY classes of hashes whether a set has an odd number of them. Two sets differ in no more of them than in members."""
    return np.array([np.packbits(np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1 == 1) for x in sets]).view(np.uint64)


def torn_links(torn: DataFrame, sets: DataFrame, pivots: Pivots, least: float = NEAR, limit: int = NEAR_LIMIT, cell: int = CELL, part: int = PART) -> DataFrame:
    """(a, b): near pairs that connect the labels of ``torn`` (node, fp, label, whole) as all near ones among the candidates of one ``whole`` do.

    Nodes come with their ``sets`` (node, shingles), once for each two parts of their whole, so candidates are judged where they are found and only links leave a task.
    A whole has one part for each ``cell`` nodes, or each ``part`` bytes of sets.
    """
    sizes = torn.join(sets.select("node", F.length("shingles").alias("size")), "node").groupBy(F.col("whole").alias("__whole"))
    sizes = sizes.agg(F.greatest(F.ceil(F.count("*") / cell), F.ceil(F.sum("size") / part)).cast("int").alias("parts")).where("parts > 1")
    rows = torn.join(sets, "node").join(sizes, F.col("whole") == F.col("__whole"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["whole", "low", "high"]
    rows = rows.select("whole", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label", "fp", "shingles")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high, part, node, label = (rows.column(k).to_numpy() for k in range(1, 6))
        names, first, at = np.unique(label, return_index=True, return_inverse=True)
        if len(names) < 2:
            return
        fp = rows.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, NEAR_WORDS)
        own = [unpacked_set(x.as_buffer()) for x in rows.column("shingles")]
        cells, odd, size = np.stack(list(pivots.cells(fp)), axis=1), parity(own), np.array([len(x) for x in own])
        forest, held, n = Forest(len(node)), [], 0
        forest.union(first[at], np.arange(len(node)))  # labels are connected already

        def out() -> pa.RecordBatch:
            a, b, bits = map(np.concatenate, zip(*held))
            # of near sets, so many members are in one alone at most
            alone = (size[a] + size[b]) * (1 - least) / (1 + least) + 1e-6
            possible = (cells[a] == cells[b]).any(axis=1) & (np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64) <= alone)
            order = np.flatnonzero(possible)[np.argsort(bits[possible], kind="stable")]
            near = [x for x in order.tolist() if similar(own[a[x]], own[b[x]], least)]
            a, b = spanning(forest, a[near], b[near])
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for found in _candidates(np.zeros(len(node), np.int64), np.where(low == high, -1, part), fp, pivots, label, limit, forest):
            held.append(found)
            n += len(found[0])
            if n > JUDGED:
                yield out()
                held.clear()
                n = 0
        if held:
            yield out()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                rest = pa.concat_tables([rest, new]) if rest is not None else new
            if rest is None or not rest.num_rows:
                continue
            whole, low, high = (rest.column(k).to_numpy() for k in range(3))
            begins = np.flatnonzero((whole[1:] != whole[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            cuts = [0, *begins.tolist()] + [rest.num_rows] * (batch is None)  # the last group may go on in the next batch
            for x, y in itertools.pairwise(cuts):
                if y - x > 1:
                    yield from found(rest.slice(x, y - x))
            rest = rest.slice(cuts[-1])

    return rows.mapInArrow(task, "a bigint, b bigint")


def near_texts(nodes: DataFrame, texts: DataFrame, least: float = NEAR) -> DataFrame:
    """(node, component): the texts of ``nodes`` (node, fp) that near pairs connect, those without one left out; ``texts`` has (node, text).

    First the candidates of spanning forests are judged. Each part that near pairs make of a forest is next to a failed candidate, if its forest
    fell apart at all. So all candidates between parts that failed ones connect are judged as well, and no near pair among the candidates is lost.
    """
    pivots = Pivots.narrow(NEAR_BLOCKS, NEAR_BITS, NEAR_WORDS, agree=1)
    found = links(nodes.select("node", "fp", F.col("node").alias("label")), NEAR_LIMIT, pivots)
    edges = stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    asked = edges.select(F.col("a").alias("__node")).union(edges.select("b")).distinct()
    # most texts have no candidate, and are not shuffled to learn that
    texts = texts.where(sieve(asked)(F.col("node"))).join(asked, F.col("node") == F.col("__node"), "left_semi").dropDuplicates(["node"])
    sets = stored(shingle_sets(texts), "shingles")
    found = judged(edges, sets, least)
    good, failed = found.where("near").select("a", "b"), found.where("NOT near").select("a", "b")
    parts = stored(components(good), "parts")
    if failed.isEmpty():
        return parts
    part = {end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")) for end in "ab"}
    ends = failed.join(part["a"], "a", "left").join(part["b"], "b", "left")
    wholes = components(ends.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))).toDF("label", "whole")
    torn = nodes.join(parts, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("label")).join(wholes, "label")
    more = torn_links(stored(torn.select("node", "fp", "label", "whole"), "torn"), sets, pivots, least)
    return components(parts.toDF("a", "b").union(more))


def deduplicate(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """One row of each group of near texts of ``docs``: the smallest doc_id, of rows that repeat it the smallest text hash, of equal rows one.

    Texts are near if their shingles of NEAR_SHINGLE words have Jaccard ``least``; groups are what near pairs connect. Candidates are texts
    within NEAR_LIMIT bits of a wide fingerprint that agree in one of NEAR_BLOCKS blocks. Texts without words are one text. A group without a doc_id keeps one row.
    """
    key = F.when(text_key("text").rlike(r"[^ \x09-\x0D]"), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))
    docs = without(docs, "__id", "__key", "__n")
    prints = stored(docs.select("doc_id", key.alias("node"), wide_fingerprints("text").alias("fp")), "prints")
    nodes = stored(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first")), "nodes")
    linked = near_texts(nodes, docs.select(key.alias("node"), "text"), least).withColumnRenamed("node", "__key")
    # of each text the row to keep, then of each group
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    rows = prints.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    rows = rows.join(linked, F.col("node") == F.col("__key"), "left").withColumn("component", F.coalesce("component", "node"))
    heads = rows.groupBy("component").agg(F.min_by("n", rank).alias("n"), F.min(rank).alias("k"))
    heads = stored(heads.select(F.col("k.doc_id").alias("__id"), F.col("k.node").alias("__key"), F.col("n").alias("__n")), "heads")
    # rows that stay as they are, most of them, are not shuffled: all others are among those that the sieve holds
    other = heads.where("__n = 1")
    other = prints.join(other, prints["doc_id"].eqNullSafe(F.col("__id")) & (prints["node"] == F.col("__key")), "left_anti")
    held = sieve(other.select(F.xxhash64("doc_id", "node").alias("row")))(F.xxhash64(F.col("doc_id"), key))
    kept = docs.where(held).join(heads, F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__key")))
    return docs.where(~held).unionAll(kept.dropDuplicates(["__id", "__key"]).drop("__id", "__key", "__n"))
