"""Language-model scores from a probabilistic suffix tree.

A text is its lower-cased words, a blank between two, and an end: a sequence of bytes. The tree's states are
contexts of up to DEPTH bytes. Training counts every byte after every context over all training texts.
A context becomes a state if its next-byte distribution diverges from that of the context without its
farthest byte (in divergence itself and in significance), and the suffixes of a state are states.
The distribution of a state is smoothed with its parent's: P(b) = (n(b) + d * P_parent(b)) / (N + d), d being its
number of different next bytes; above the root stands the uniform distribution over bytes. A byte is scored by the
longest state that ends its context.

Only counts of the longest contexts are shuffled, packed by bucket: the NEAR bytes next before a byte. All longer contexts and their parents are in
one bucket, so a bucket's part of the tree is made, tested, stored and asked on its own; the levels above it are few and in every
task. Every counted entry takes part. Tasks also hold the scores of keys above MIN_SHARE of all bytes, at most 1 / MIN_SHARE of them,
which changes no result; the other bytes of a text are asked for by bucket, and their sums come back by text.

Beside it stands a smoothed unigram model over words, for which every word is looked up in the counts: frequent
words in each task, the others by a join, where no word is frequent enough to be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.scan import LOWER, SPACE, buffers, hashes, pieces, words
from spendlake.llm.shared import stored, without

DEPTH = 6
#: The score of a key of this share of all is held in the tasks, so there are at most 1 / MIN_SHARE such keys.
MIN_SHARE = 1e-7
#: A state's distribution differs from its parent's by so many nats at least.
DIVERGENCE = 0.005
#: A word of this share of all is looked up in the tasks, so there are at most 1 / FREQUENT such words.
FREQUENT = 5e-7
PIECE = 1 << 20
#: Different keys that a task counts before it passes them on.
HELD = 1 << 20
#: Bytes next before a byte that are its bucket; the bits of a key that are not; buckets of words; bytes of rows that a task looks at together.
NEAR = 3
REST = 8 * (DEPTH - NEAR) + 8
REST_MASK = (1 << REST) - 1
LOWER_LEVELS = range(NEAR, DEPTH + 1)
WORD_BUCKETS = 1 << 10
CHUNK = 16 << 20
#: A row's number is its partition and, in so many bits, its place there. Bytes of keys that are asked of a bucket in one place.
PART = 40
HOT = 32 << 20
END = 0x0A
#: The key of the end token among the word hashes.
END_KEY = -1
WORD = -1


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all normalised texts in a row, bytes before each and of all, word hashes, words before each text and of all)."""
    held = np.insert(LOWER[data], offsets[1:], END)  # so that a byte follows every word
    bounds = offsets + np.arange(len(offsets))
    inside = ~SPACE[held]
    starts, ends, before = words(inside, bounds)
    hashed = hashes(held, starts, ends)
    held[ends] = 0x20
    inside[ends] = True
    some = np.diff(before) > 0
    held[ends[before[1:][some] - 1]] = END
    empty = bounds[1:][~some] - 1
    held[empty], inside[empty] = END, True
    return held[inside], np.concatenate([[0], np.cumsum(inside)])[bounds], hashed, before


def contexts(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte an integer of the DEPTH bytes before it, the nearest in front, and the byte itself; END stands before a text."""
    wide = np.concatenate([np.full(DEPTH, END, np.uint8), text, np.zeros(8, np.uint8)])
    keys = np.lib.stride_tricks.as_strided(wide, (len(text), 8), (1, 1)).copy().view("<u8")[:, 0]
    before = keys & np.uint64((1 << 8 * DEPTH) - 1)
    keys = (before << np.uint64(8) | keys >> np.uint64(8 * DEPTH) & np.uint64(255)).astype(np.int64)
    sizes = np.diff(bounds)
    for j in range(DEPTH):
        at = bounds[:-1][sizes > j] + j
        low = 8 * (DEPTH - j)  # the bits of the contexts that lie before the text
        filling = sum(END << 8 * k for k in range(DEPTH - j))
        keys[at] = (keys[at] >> 8 >> low << low | filling) << 8 | keys[at] & 255
    return keys


def shorter(keys: np.ndarray, by: int = 1) -> np.ndarray:
    """The keys with ``by`` of the farthest bytes of their contexts left out."""
    return keys >> 8 >> 8 * by << 8 | keys & 255


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, unique = pd.factorize(np.concatenate(keys))
    return unique, np.bincount(codes, np.concatenate(counts), len(unique)).astype(np.int64)


class Counter:
    """Counts keys and passes them on when it holds many."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        codes, unique = pd.factorize(keys)
        self.keys.append(unique)
        self.counts.append(np.bincount(codes, minlength=len(unique)))
        self.held += len(unique)
        if self.held > HELD:
            self.keys, self.counts = ([x] for x in _summed(self.keys, self.counts))
            self.held = len(self.keys[0])
        return self.held > HELD // 2

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(self.keys, self.counts) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.__init__()
        return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys among sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def packed(rows: np.ndarray, of: np.ndarray, values: np.ndarray) -> pa.Array:
    """For each of ``rows`` (ascending) the bytes of the values whose ``of`` (ascending) is equal to it."""
    ends = np.searchsorted(of, rows, side="right")
    starts = np.searchsorted(of, rows, side="left")
    offsets = np.append(starts, ends[-1:]) if len(rows) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number of values of each)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different keys and the sums of their n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(n[order], starts)


def count(training: DataFrame) -> DataFrame:
    """(bucket, keys, n) of the texts, packed: bytes after their longest contexts; words by hash in buckets below zero."""

    def of_words(counter: Counter) -> pa.RecordBatch:
        keys, n = counter.empty()
        bucket = -1 - (keys & (WORD_BUCKETS - 1))
        order = np.argsort(bucket, kind="stable")
        return batch_of(bucket[order], keys[order], n[order])

    def of_bytes(counter: Counter) -> pa.RecordBatch:
        keys, n = counter.empty()
        order = np.argsort(keys)
        return batch_of(keys[order] >> REST, (keys[order] & REST_MASK).astype("<u4"), n[order].astype("<u4"))

    def batch_of(bucket: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = np.unique(bucket)
        return pa.RecordBatch.from_arrays([pa.array(rows), packed(rows, bucket, keys), packed(rows, bucket, n)], names=["bucket", "keys", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_counts, byte_counts, texts = Counter(), Counter(), 0
        for batch in batches:
            for first, end, data, offsets in pieces(*buffers(batch.column(0)), PIECE):
                text, bounds, hashed, _ = sequence(data, offsets)
                texts += end - first
                if word_counts.add(hashed.view(np.int64)):
                    yield of_words(word_counts)
                if byte_counts.add(contexts(text, bounds)):
                    yield of_bytes(byte_counts)
        if texts:
            word_counts.keys.append(np.array([END_KEY]))
            word_counts.counts.append(np.array([texts]))
            yield of_words(word_counts)
            yield of_bytes(byte_counts)

    return training.select("text").mapInArrow(task, "bucket bigint, keys binary, n binary")


@dataclass
class Level:
    """Counts of bytes after contexts of one length: ascending keys with n; of each context total, number of different bytes and whether it is a state."""

    keys: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    starts: np.ndarray
    total: np.ndarray
    different: np.ndarray
    state: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, state: bool = False) -> Level:
        context = keys >> 8
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, starts) if len(keys) else n
        return cls(keys, n, context[starts], starts, total, np.diff(np.append(starts, len(keys))), np.full(len(starts), state))

    @property
    def states(self) -> list[int]:
        return self.contexts[self.state].tolist()

    def test(self, parent: Level, divergence: float) -> None:
        """Marks the contexts whose distribution diverges from their parents'."""
        if not len(self.keys):
            return
        above = shorter(self.keys)
        share = parent.n[_find(parent.keys, above)[0]] / parent.total[_find(parent.contexts, above >> 8)[0]]
        gain = np.add.reduceat(self.n * np.log(self.n / np.repeat(self.total, self.different) / share), self.starts)
        free = np.maximum(self.different - 1, 1)
        self.state |= (gain >= divergence * self.total) & (2 * gain >= free + 4 * np.sqrt(2 * free))

    def close(self, states: np.ndarray) -> None:
        """Marks the suffixes of ``states``, which are one byte longer."""
        self.state |= np.isin(self.contexts, states >> 8)

    def step(self, p: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The probabilities of keys whose parents have ``p``."""
        at, known = _find(self.contexts, keys >> 8)
        if not known.any():
            return p
        known &= self.state[at]
        entry, found = _find(self.keys, keys)
        n, d = np.where(found, self.n[entry], 0), self.different[at]
        return np.where(known, (n + d * p) / (self.total[at] + d), p)


def below(keys: np.ndarray, n: np.ndarray, levels: int) -> list[Level]:
    """The level of ``keys`` and the ``levels`` above it, the shortest contexts first."""
    out = [Level.of(keys, n)]
    for _ in range(levels):
        out.insert(0, Level.of(*totals(shorter(out[0].keys), out[0].n)))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together to about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n > size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else pa.array([], column.type) if isinstance(column, pa.ChunkedArray) else column


def bits_of(level: int) -> int:
    """Bits of a key of a level that the bucket does not tell."""
    return 8 * (level - NEAR) + 8


TREES = "bucket bigint, forced boolean, " + ", ".join(f"k{k} binary, n{k} binary" for k in LOWER_LEVELS) + ", often binary, words binary, words_n binary"


def trees(counts: DataFrame, least: float, divergence: float) -> DataFrame:
    """A row per bucket: the entries of its contexts of NEAR bytes, and of the longer ones that are states; keys with n >= ``least``; counts of words.

    ``forced`` tells that a longer state makes the bucket's own context one.
    """
    schema = pa.schema([("bucket", pa.int64()), ("forced", pa.bool_()), *((f"{c}{k}", pa.binary()) for k in LOWER_LEVELS for c in "kn"), *((c, pa.binary()) for c in ("often", "words", "words_n"))])

    def out(rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def of_bytes(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        levels = below(keys, n, DEPTH - NEAR)
        for parent, child in zip(levels, levels[1:]):
            child.test(parent, divergence)
        for parent, child in reversed(list(zip(levels, levels[1:]))):
            parent.close(child.contexts[child.state])
        rows = levels[0].contexts
        columns = {"bucket": pa.array(rows), "forced": pa.array(levels[0].state)}
        for k, level in zip(LOWER_LEVELS, levels):
            kept = np.repeat(level.state | (k == NEAR), level.different)
            own = level.keys[kept]
            columns |= {f"k{k}": packed(rows, own >> bits_of(k), (own & ((1 << bits_of(k)) - 1)).astype("<u4")), f"n{k}": packed(rows, own >> bits_of(k), level.n[kept])}
        own = keys[n >= least]
        return out(len(rows), columns | {"often": packed(rows, own >> REST, (own & REST_MASK).astype("<u4"))})

    def of_words(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = -1 - (keys & (WORD_BUCKETS - 1))
        order = np.argsort(bucket, kind="stable")
        rows = np.unique(bucket)
        return out(len(rows), {"bucket": pa.array(rows), "words": packed(rows, bucket[order], keys[order]), "words_n": packed(rows, bucket[order], n[order])})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by bucket; what is held is one open bucket, summed, and a chunk
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        word_keys, word_n = keys, n
        for table in _chunks(batches, CHUNK):
            bucket = _column(table, "bucket").to_numpy()
            words = int(np.searchsorted(bucket, 0))
            if words:
                part = table.slice(0, words).combine_chunks()
                new, _ = unpacked(_column(part, "keys"), "<i8")
                word_keys, word_n = totals(np.append(word_keys, new), np.append(word_n, unpacked(_column(part, "n"), "<i8")[0]))
            if words == len(bucket):
                continue
            if len(word_keys):
                yield of_words(word_keys, word_n)
                word_keys, word_n = word_keys[:0], word_n[:0]
            part = table.slice(words).combine_chunks()
            rest, sizes = unpacked(_column(part, "keys"), "<u4")
            own = np.repeat(bucket[words:], sizes) << REST | rest.astype(np.int64)
            keys, n = totals(np.append(keys, own), np.append(n, unpacked(_column(part, "n"), "<u4")[0].astype(np.int64)))
            done = int(np.searchsorted(keys, bucket[-1] << REST))
            if done:
                yield of_bytes(keys[:done], n[:done])
                keys, n = keys[done:], n[done:]
        if len(word_keys):
            yield of_words(word_keys, word_n)
        if len(keys):
            yield of_bytes(keys, n)

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, TREES)


def _lower(table: pa.Table, upper: list[Level], divergence: float) -> list[Level]:
    """The levels of the buckets in ``table`` (rows of ``trees``), ready to be asked."""
    bucket, first = np.unique(_column(table, "bucket").to_numpy(), return_index=True)
    if len(first) < table.num_rows or (np.diff(first) < 0).any():
        table = table.take(pa.array(first)).combine_chunks()
    out = []
    for k in LOWER_LEVELS:
        rest, sizes = unpacked(_column(table, f"k{k}"), "<u4")
        keys = np.repeat(bucket, sizes) << bits_of(k) | rest.astype(np.int64)
        out.append(Level.of(keys, unpacked(_column(table, f"n{k}"), "<i8")[0].copy(), state=k > NEAR))
    out[0].state |= np.asarray(_column(table, "forced").to_numpy(zero_copy_only=False), bool)
    out[0].test(upper[-1], divergence)
    return out


def logs(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of bytes after their contexts, by all levels."""
    p = np.full(len(keys), 1 / 256)
    for k, level in enumerate(levels):
        p = level.step(p, shorter(keys, DEPTH - k))
    return np.log10(p)


class Tree:
    """The tree: ``nodes``, a written table with a row per bucket, and the levels of fewer than NEAR bytes."""

    def __init__(self, nodes: DataFrame, divergence: float = DIVERGENCE) -> None:
        self.nodes, self.divergence = nodes, divergence

        def seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _chunks(batches, CHUNK):
                rest, sizes = unpacked(_column(table, f"k{NEAR}"), "<u4")
                own = np.repeat(_column(table, "bucket").to_numpy(), sizes) << bits_of(NEAR) | rest.astype(np.int64)
                keys, n = totals(shorter(own), unpacked(_column(table, f"n{NEAR}"), "<i8")[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        # all bytes after NEAR - 1 others: at most 2 ** (8 * NEAR) rows, and as few as a language has
        found = nodes.mapInArrow(seconds, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        self.upper = below(*totals(found.column("key").to_numpy(), found.column("n").to_numpy()), NEAR - 1)
        self.upper[0].state[:] = True
        for parent, child in zip(self.upper, self.upper[1:]):
            child.test(parent, divergence)
        upper = self.upper

        def forced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _chunks(batches, CHUNK):
                level = _lower(table, upper, divergence)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(level.contexts[level.state] >> 8))], names=["context"])

        # at most 2 ** (8 * (NEAR - 1)) rows
        states = nodes.mapInArrow(forced, "context bigint").distinct().toArrow().column(0).to_numpy()
        self.upper[-1].close(states << 8)
        for parent, child in reversed(list(zip(self.upper, self.upper[1:]))):
            parent.close(child.contexts[child.state])

    def often(self) -> DataFrame:
        """(key, log) of the keys that were counted often."""
        upper, divergence = self.upper, self.divergence

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _chunks(batches, CHUNK):
                rest, sizes = unpacked(_column(table, "often"), "<u4")
                keys = np.repeat(_column(table, "bucket").to_numpy(), sizes) << REST | rest.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(logs(upper + _lower(table, upper, divergence), keys))], names=["key", "log"])

        return self.nodes.mapInArrow(task, "key bigint, log double")

    def sums(self, asked: DataFrame) -> DataFrame:
        """(row, sum): the sum of the logs of all keys that each row asks for; ``asked`` has __row and __keys.

        Keys go to their buckets, packed; a bucket that is asked for by more than HOT bytes is in several places. Sums by row come back.
        """
        upper, divergence, nodes = self.upper, self.divergence, self.nodes

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                sizes = np.diff(np.asarray(lists.offsets))
                rows, keys = np.repeat(batch.column(0).to_numpy(), sizes), lists.flatten().to_numpy()
                part = rows >> PART
                for p in np.unique(part).tolist():
                    own = np.flatnonzero(part == p)
                    own = own[np.argsort(keys[own] >> REST, kind="stable")]
                    bucket = keys[own] >> REST
                    places = np.unique(bucket)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(places), pa.array(np.full(len(places), p)), packed(places, bucket, (keys[own] & REST_MASK).astype("<u4")), packed(places, bucket, (rows[own] & ((1 << PART) - 1)).astype("<u4"))],
                        names=["bucket", "part", "rest", "row"],
                    )

        asks = asked.select("__row", "__keys").mapInArrow(pack, "bucket bigint, part bigint, rest binary, row binary")
        hot = asks.groupBy("bucket").agg(F.sum(F.octet_length("rest")).alias("size")).where(F.col("size") > HOT)
        hot = stored(hot.select(F.col("bucket").alias("__hot"), F.ceil(F.col("size") / HOT).cast("int").alias("cuts")), "hot")
        # at most the asked bytes / HOT rows
        cuts = F.coalesce("cuts", F.lit(1))
        asks = asks.join(hot, F.col("bucket") == F.col("__hot"), "left").withColumn("cut", F.pmod(F.xxhash64("part"), cuts).cast("int")).drop("__hot", "cuts")
        held = nodes.drop("often", "words", "words_n").join(hot, F.col("bucket") == F.col("__hot"), "left")
        held = held.withColumn("cut", F.explode(F.sequence(F.lit(0), cuts - 1))).withColumn("part", F.lit(-1).cast("bigint")).drop("__hot", "cuts")
        rows = held.unionByName(asks, allowMissingColumns=True).repartition("bucket", "cut").sortWithinPartitions("bucket", "cut", "part")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_tree, found_rows, found = None, [], []

            def out() -> pa.RecordBatch:
                codes, unique = pd.factorize(np.concatenate(found_rows), sort=True)
                parts, part = np.unique(unique >> PART), unique >> PART
                place, total = (unique & ((1 << PART) - 1)).astype("<u4"), np.bincount(codes, np.concatenate(found), len(unique))
                return pa.RecordBatch.from_arrays([pa.array(parts), packed(parts, part, place), packed(parts, part, total)], names=["part", "row", "sum"])

            for table in _chunks(batches, CHUNK):
                table = pa.concat_tables([open_tree, table]).combine_chunks() if open_tree is not None else table
                part = _column(table, "part").to_numpy()
                tree, ask = table.filter(pa.array(part < 0)).combine_chunks(), table.filter(pa.array(part >= 0)).combine_chunks()
                rest, sizes = unpacked(_column(ask, "rest"), "<u4")
                keys = np.repeat(_column(ask, "bucket").to_numpy(), sizes) << REST | rest.astype(np.int64)
                own = np.repeat(_column(ask, "part").to_numpy(), sizes) << PART | unpacked(_column(ask, "row"), "<u4")[0].astype(np.int64)
                if len(keys):
                    found_rows.append(own)
                    found.append(logs(upper + _lower(tree, upper, divergence), keys))
                if sum(map(len, found)) > HELD:
                    yield out()
                    found_rows, found = [], []
                # the open bucket's tree, which comes before all that ask for it
                last = _column(table, "bucket").to_numpy()[-1]
                open_tree = tree.filter(pa.array(_column(tree, "bucket").to_numpy() == last))
            if found:
                yield out()

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a part's texts are numbered from 0, so their sums are an array
            part, sums = None, np.zeros(0)

            def out() -> pa.RecordBatch:
                place = np.flatnonzero(sums)
                return pa.RecordBatch.from_arrays([pa.array(part << PART | place), pa.array(sums[place])], names=["row", "sum"])

            for batch in batches:
                for k, p in enumerate(batch.column(0).to_pylist()):
                    if p != part:
                        if part is not None:
                            yield out()
                        part, sums = p, np.zeros(0)
                    place, own = unpacked(batch.column(1).slice(k, 1), "<u4")[0].astype(np.int64), unpacked(batch.column(2).slice(k, 1), "<f8")[0]
                    sums = np.append(sums, np.zeros(max(0, int(place.max(initial=-1)) + 1 - len(sums))))
                    sums[place] += own  # a place occurs once in a row
            if part is not None:
                yield out()

        found = rows.mapInArrow(answer, "part bigint, row binary, sum binary").repartition("part").sortWithinPartitions("part")
        return found.mapInArrow(total, "row bigint, sum double")

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of a few keys."""
        table = self.nodes.where(F.col("bucket").isin(np.unique(keys >> REST).tolist())).toArrow().combine_chunks()
        return logs(self.upper + _lower(table, self.upper, self.divergence), keys)

    @property
    def levels(self) -> list[Level]:
        """All levels, of a small tree."""
        return self.upper + _lower(self.nodes.orderBy("bucket").toArrow().combine_chunks(), self.upper, self.divergence)


@dataclass(frozen=True)
class Tables:
    """What each task holds: of frequent keys (sorted) the log probability, of frequent words (sorted hashes) the counts; the totals."""

    keys: np.ndarray
    log: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))


@dataclass(frozen=True)
class Model:
    """The tree, whole; what the tasks hold of it and of the unigram model."""

    tree: Tree
    held: Tables


def _sorted(table: pa.Table, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(table.column(key).to_numpy())
    return table.column(key).to_numpy()[order], table.column(value).to_numpy()[order]


def train(training: DataFrame) -> tuple[Model, DataFrame]:
    """(model, counts of the words that are not frequent) of ``training`` (text); null texts are empty."""
    size = training.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    made = stored(trees(count(training), size * MIN_SHARE, DIVERGENCE), "trees")
    tree = Tree(made.where("bucket >= 0").drop("words", "words_n"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(column, "<i8")[0]) for column in batch.columns], names=["key", "n"])

    of_words = made.where("bucket < 0").select("words", "words_n").mapInArrow(unpack, "key bigint, n bigint")
    tokens, vocabulary = of_words.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    often = tree.often().toArrow()  # at most 1 / MIN_SHARE rows
    frequent = (F.col("n") >= tokens * FREQUENT) | (F.col("key") == END_KEY)
    hot = of_words.where(frequent).toArrow()  # at most 1 / FREQUENT + 1 rows
    held = Tables(*_sorted(often, "key", "log"), *_sorted(hot, "key", "n"), tokens, vocabulary)
    return Model(tree, held), of_words.where(~frequent)


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """``docs`` without text, and n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the tree's log10 probability of the text, ``base_score`` the unigram model's. Tokens are the words and
    one end; a null or empty text is the end alone. Without training texts every byte is as likely as any
    other. Every row gives a row, also where ids repeat; columns named as a result are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, *RESULTS, "__row", "__rare", "__keys").select(F.col("text").alias("__text"), *(c for c in docs.columns if c != "text" and c not in RESULTS))
    shared = spark.sparkContext.broadcast(model.held)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = shared.value, TaskContext.get().partitionId() << PART
        for batch in batches:
            for first, end, data, offsets in pieces(*buffers(batch.column(0)), PIECE):
                text, bounds, hashed, before = sequence(data, offsets)
                codes, unique = pd.factorize(contexts(text, bounds))
                order = np.argsort(unique)  # in this order look-ups are near each other
                place, cached = np.empty(len(unique), np.int64), np.empty(len(unique), bool)
                place[order], cached[order] = _find(of.keys, unique[order])
                log = np.where(cached, of.log[place] if len(of.log) else 0.0, 0.0)
                total = np.add.reduceat(log[codes], bounds[:-1])
                absent = ~cached[codes]
                others_upto = np.concatenate([[0], np.cumsum(absent)])[bounds]
                keys = pa.ListArray.from_arrays(pa.array(others_upto.astype(np.int32)), pa.array(unique[codes[absent]]))
                at, known = _find(of.words, np.append(hashed.view(np.int64), END_KEY))
                c = np.where(known, of.counts[at] if len(of.counts) else 0, 0)
                upto = np.concatenate([[0], np.cumsum(known[:-1])])
                base = np.concatenate([[0], np.cumsum(np.where(known, of.unigram(c), 0)[:-1])])
                last = of.unigram(c[-1:])[0]
                others = hashed.view(np.int64)[~known[:-1]]
                lists = pa.ListArray.from_arrays(pa.array((before - upto[before]).astype(np.int32)), pa.array(others))
                columns = [
                    pa.array(row + np.arange(end - first)), pa.array(np.diff(before) + 1), pa.array(np.diff(upto[before]) + int(known[-1])),
                    pa.array(np.diff(base[before]) + last), pa.array(total), lists, keys,
                ]
                row += end - first
                rest = batch.slice(first, end - first).columns[1:]
                yield pa.RecordBatch.from_arrays([*columns, *rest], names=["__row", "n_tokens", "n_known", "base_score", "score", "__rare", "__keys", *batch.schema.names[1:]])

    schema = "__row bigint, n_tokens bigint, n_known bigint, base_score double, score double, __rare array<bigint>, __keys array<bigint>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    found = stored(docs.mapInArrow(task, schema + (", " + kinds if kinds else "")), "scored")
    spread = found.select("__row", F.explode("__rare").alias("__word"))
    each = spread.join(rare, F.col("__word") == F.col("key"), "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(model.held.tokens + 0.1 * (model.held.vocabulary + 1)))
    each = each.groupBy(F.col("__row").alias("__of")).agg(F.sum(log).alias("__log"), F.count("n").alias("__known"))
    bytes_of = model.tree.sums(found).select(F.col("row").alias("__text"), F.col("sum").alias("__sum"))
    out = found.drop("__rare", "__keys").join(each, F.col("__row") == F.col("__of"), "left").join(bytes_of, F.col("__row") == F.col("__text"), "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("__sum", F.lit(0.0)))
    out = out.withColumn("n_known", F.col("n_known") + F.coalesce("__known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("__log", F.lit(0.0)))
    return out.withColumn("train_tokens", F.lit(model.held.tokens).cast("bigint")).drop("__row", "__of", "__text", "__sum", "__log", "__known")
