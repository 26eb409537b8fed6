"""Spelling variants of a vocabulary by search schemes over bidirectional FM-indexes.

Two words are near if one inserted, deleted or replaced character makes them equal. Then one half of a word stands
unchanged in the other: at its beginning if it is the first half, at its end if it is the second. So a word is searched twice: its first half
is matched exactly from the word's start and extended to the right, its second half from the word's end and extended to the left,
with one error allowed on the way, by intervals of suffix ranks over the words between delimiters.

The halves also say where to search: words of LEAST_LENGTH characters or more agree in their first or their last HEAD
characters. The vocabulary is dealt by these into blocks of about BLOCK words, each with an index of its own; a beginning or end of
more words than that is cut into several blocks, and its words are searched in all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.shared import stored

LEAST_LENGTH = 6
#: The shorter half of the shortest word.
HEAD = LEAST_LENGTH // 2
LEAST_COUNT = 5
#: A word's form is at least so many times as frequent.
RATIO = 5
#: One run in so many, by a hash of its document and itself, loses a character.
TYPO = 199
#: Words of an index, in expectation, and words that are searched together.
BLOCK = 1 << 15
QUERIES = 1 << 12
#: Different words that a task counts before it passes them on, and bytes of a text that are looked at together.
HELD = 1 << 18
PIECE = 1 << 20

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z became a-z; and a byte that is in no run and no character of several bytes.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes that cut no run."""
    at = 0
    while at < len(raw):
        found = BREAK.search(raw, at + size) if at + size < len(raw) else None
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def count_runs(docs: DataFrame, typo: int = TYPO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of the runs of letters in ``docs`` (doc_id, text), of ``least_length`` characters or more.

    Let h be the crc32 of ``<doc_id>:<run>``; where ``typo`` divides h, the run loses its character number h modulo its length. A null
    doc_id is the empty text, a null text has no runs.
    """

    def out(counts: Counter) -> pa.RecordBatch:
        kept = [w for w in counts if len(w) - w.count(0xC3) >= least_length and counts[w]]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in kept], pa.int64())], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, crc32 = Counter(), zlib.crc32
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                base = crc32(f"{doc_id.as_py()}:".encode())
                for piece in pieces(text.as_py().lower()):
                    found = RUN.findall(piece)
                    counts.update(found)
                    for w in [w for w in found if crc32(w, base) % typo == 0]:
                        h, letters = crc32(w, base), w.decode()
                        at = h % len(letters)
                        counts[w] -= 1
                        counts[(letters[:at] + letters[at + 1 :]).encode()] += 1
                    if len(counts) > HELD:
                        yield out(counts)
                        counts = Counter()
        yield out(counts)

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Ranks:
    """A wavelet matrix: counts of a symbol, and of smaller ones, in ranges of a sequence."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.bits = range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1)
        self.zeros: list[np.ndarray] = []
        for b in self.bits:
            is_zero = (symbols >> b & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(is_zero, dtype=np.int32)]).astype(np.int32))
            symbols = np.concatenate([symbols[is_zero], symbols[~is_zero]])
        # where each symbol's occurrences begin after the last level
        self.start = np.zeros(kinds, np.int64)
        for c in range(kinds):
            at = 0
            for b, zeros in zip(self.bits, self.zeros):
                at = int(zeros[at]) if not c >> b & 1 else int(zeros[-1]) + at - int(zeros[at])
            self.start[c] = at

    def of(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrences of ``c`` before ``low``, in the range, smaller symbols in the range)."""
        less = np.zeros(len(c), np.int64)
        for b, zeros in zip(self.bits, self.zeros):
            one = (c >> b & 1).astype(bool)
            before, upto = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            less += np.where(one, upto - before, 0)
            low = np.where(one, zeros[-1] + low - before, before)
            high = np.where(one, zeros[-1] + high - upto, upto)
        return low - self.start[c], high - low, less

    def all(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``of``, for every symbol that a range holds: (row, symbol, occurrences before, in the range, smaller ones)."""
        row, symbol, less = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for b, zeros in zip(self.bits, self.zeros):
            before, upto = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            none, some = upto > before, high - low > upto - before
            row, symbol = np.concatenate([row[none], row[some]]), np.concatenate([symbol[none], symbol[some] | 1 << b])
            less = np.concatenate([less[none], (less + upto - before)[some]])
            low, high = np.concatenate([before[none], (zeros[-1] + low - before)[some]]), np.concatenate([upto[none], (zeros[-1] + high - upto)[some]])
        return row, symbol, low - self.start[symbol], high - low, less


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order; the last symbol is smaller than all others. Prefixes are doubled until all ranks differ."""
    rank, step, n = text.astype(np.int64), 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, step = new, min(2 * step, n - 1) or 1
        if rank[order[-1]] == n - 1:
            return order


#: Symbols that end the text, and that stand between words.
END, BAR = 0, 1
RIGHT, LEFT = 0, 1


class Index:
    """A bidirectional FM-index over distinct words between delimiters.

    A pattern is its interval of ranks among the suffixes, that of its reversal among those of the reversed text, and their
    common length; an extension to one side steps backward in one of the two and narrows the other.
    """

    def __init__(self, words: list[str]) -> None:
        letters = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), "<u4")
        self.alphabet = np.unique(letters)  # \0, the delimiter, is the first
        text = np.searchsorted(self.alphabet, letters) + BAR
        kinds = len(self.alphabet) + BAR
        self.bars = np.flatnonzero(text == BAR)
        forward, backward = np.append(text, END), np.append(text[::-1], END)
        self.suffixes = suffix_array(forward)
        # a step to the right is a backward step in the reversed text
        self.ranks = {LEFT: Ranks(forward[self.suffixes - 1], kinds), RIGHT: Ranks(backward[suffix_array(backward) - 1], kinds)}
        self.first = np.concatenate([[0], np.cumsum(np.bincount(forward, minlength=kinds))])

    def codes(self, word: str) -> np.ndarray:
        """The symbols of a word; -1 for one that no word of the index has."""
        letters = np.frombuffer(word.encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at + BAR, -1)

    def near(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers: the words at one error from each query that share its first half (RIGHT), or its second (LEFT).

        Side RIGHT matches the first half after a delimiter and goes on to the right; LEFT does the same from the end to the left.
        """
        n = len(words)
        length = np.array([len(w) for w in words])
        exact = length // 2 if side == RIGHT else length - length // 2
        wide = np.full((n, int(length.max(initial=0)) + 2), BAR, np.int64)  # a delimiter behind the last character
        for k, w in enumerate(words):
            codes = self.codes(w)
            wide[k, : len(w)] = codes if side == RIGHT else codes[::-1]
        ranks = self.ranks[side]

        def step(c: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            before, found, less = ranks.of(np.maximum(c, 0), a, a + size)
            return self.first[np.maximum(c, 0)] + before, b + less, np.where(c < 0, 0, found)

        query = np.arange(n)
        a = b = np.full(n, self.first[BAR])
        size = np.full(n, self.first[BAR + 1] - self.first[BAR])
        for at in range(int(exact.max(initial=0))):
            go = at < exact[query]
            na, nb, ns = step(wide[query, at], a, b, size)
            a, b, size = np.where(go, na, a), np.where(go, nb, b), np.where(go, ns, size)
            some = size > 0
            query, a, b, size = query[some], a[some], b[some], size[some]
        at, erred = exact[query], np.zeros(len(query), bool)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            here = wide[query, at]
            na, nb, ns = step(here, a, b, size)
            grown = [(query, at + 1, erred, na, nb, ns)]
            free = np.flatnonzero(~erred)
            row, c, before, found, less = ranks.all(a[free], a[free] + size[free])
            row = free[row]
            letter = c > BAR
            row, c, before, found, less = row[letter], c[letter], before[letter], found[letter], less[letter]
            ca, cb, yes = self.first[c] + before, b[row] + less, np.ones(len(row), bool)
            inside = at[row] < length[query[row]]
            swap = inside & (c != here[row])
            grown.append((query[row][swap], at[row][swap] + 1, yes[swap], ca[swap], cb[swap], found[swap]))
            grown.append((query[row], at[row], yes, ca, cb, found))  # a character more
            drop = free[at[free] < length[query[free]]]  # a character less
            grown.append((query[drop], at[drop] + 1, np.ones(len(drop), bool), a[drop], b[drop], size[drop]))
            query, at, erred, a, b, size = map(np.concatenate, zip(*grown))
            some = size > 0
            query, at, erred, a, b, size = query[some], at[some], erred[some], a[some], b[some], size[some]
            done = at > length[query]
            end = done & erred
            rank = (b if side == RIGHT else a)[end]  # a whole word between delimiters occurs once
            hits.append((query[end], np.searchsorted(self.bars, self.suffixes[rank])))
            query, at, erred, a, b, size = query[~done], at[~done], erred[~done], a[~done], b[~done], size[~done]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate([q for q, _ in hits]) << 32 | np.concatenate([w for _, w in hits]))
        return both >> 32, both & 0xFFFFFFFF


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of ``words`` (word, n): how many words are near, the largest n among them and the first such word.

    Words are distinct and have LEAST_LENGTH characters or more; words without a near one give no row. Every word is searched in
    the blocks of its beginning and of its end, so that the work grows with the words.
    """
    n = words.count()
    parts = max(1, -(-2 * n // block))
    sides = F.array(F.struct(F.lit(RIGHT).alias("side"), F.substring("word", 1, HEAD).alias("key")), F.struct(F.lit(LEFT).alias("side"), F.expr(f"right(word, {HEAD})").alias("key")))
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.key")
    cells = rows.groupBy("side", "key").agg(F.count("*").alias("size")).where(F.col("size") > block)  # at most 2 / block of the words
    cells = cells.select(F.col("side").alias("__side"), F.col("key").alias("__key"), F.ceil(F.col("size") / block).cast("int").alias("cuts"))
    rows = rows.join(F.broadcast(cells), (F.col("side") == F.col("__side")) & (F.col("key") == F.col("__key")), "left")
    own = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
    alone = F.col("cuts").isNull()
    rows = rows.select("side", "word", "n", "key", alone.alias("alone"), F.coalesce(own, F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias("cut"))
    group = F.when(F.col("alone"), F.xxhash64("side", F.pmod(F.xxhash64("key"), F.lit(parts)))).otherwise(F.xxhash64("side", "key", "cut"))
    home = F.array(F.lit(0), F.lit(1))
    rows = rows.select(group.alias("block"), "side", F.explode(F.when(F.col("own") == F.col("cut"), home).otherwise(F.array(F.lit(1)))).alias("role"), "word", "n")
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "side", "role", "word")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, counts, index = None, [], [], None
        for batch in batches:
            block_of, side_of, role_of = (batch.column(k).to_numpy() for k in range(3))
            change = (block_of[1:] != block_of[:-1]) | (side_of[1:] != side_of[:-1]) | (role_of[1:] != role_of[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (block_of[a], side_of[a]) != place:
                    place, held, counts, index = (block_of[a], side_of[a]), [], [], None
                own = batch.column(3).slice(a, b - a).to_pylist()
                if role_of[a] == 0:
                    held += own
                    counts += batch.column(4).slice(a, b - a).to_pylist()
                    continue
                index = index or Index(held)
                for first in range(0, len(own), QUERIES):
                    yield _found(index, held, counts, own[first : first + QUERIES], int(place[1]))

    found = rows.mapInArrow(task, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("m"))
    return found.select("word", "n_near", (-F.col("m.minus")).alias("best_n"), F.col("m.best").alias("best"))


def _found(index: Index, held: list[str], counts: list[int], queries: list[str], side: int) -> pa.RecordBatch:
    near: dict[int, tuple[int, int, str]] = {}
    for q, w in zip(*(x.tolist() for x in index.near(queries, side))):
        word, other = queries[q], held[w]
        if side == LEFT and other.startswith(word[: len(word) // 2]):
            continue  # found from the other side
        n, minus, best = near.get(q, (0, 1, ""))
        near[q] = (n + 1, *min((minus, best), (-counts[w], other)))
    return pa.RecordBatch.from_arrays(
        [pa.array([queries[q] for q in near], pa.string()), pa.array([x[0] for x in near.values()], pa.int64()), pa.array([-x[1] for x in near.values()], pa.int64()), pa.array([x[2] for x in near.values()], pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def roots(links: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of ``links`` (word, form), a forest: pointers are doubled ``rounds`` times."""
    up = links.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        above = up.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        up = stored(up.join(above, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root")), "roots")
    return up


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, typo: int = TYPO, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word in ``docs`` (doc_id, text) of LEAST_LENGTH characters and ``least_count`` occurrences.

    ``form`` is the near word of largest n (of several the first in code-point order) if it is ``ratio`` times as frequent or more, else null;
    ``root`` the last word that forms lead to, the word itself if it has none. Repeated rows count again; null texts have no words; an empty table gives no row.
    """
    words = stored(count_runs(docs, typo).where(F.col("n") >= least_count), "words")
    near = near_words(words, block)
    table = words.join(near.withColumnRenamed("word", "__of"), F.col("word") == F.col("__of"), "left").drop("__of")
    kept = F.col("best_n") >= ratio * F.col("n")
    table = table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n"))
    table = stored(table, "forms")
    # n grows by the ratio with every step, so the longest way is the logarithm of the largest n
    most, steps = table.agg(F.max("n")).first()[0] or 1, 1
    while least_count * ratio**steps <= most:
        steps += 1
    up = roots(table.where("form IS NOT NULL"), steps.bit_length())
    return table.join(up.withColumnRenamed("word", "__of"), F.col("word") == F.col("__of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
