"""Token ids in bit-packed binary files.

A file holds the ids of documents in ascending order of doc_id, or as they are stored, every id in the fewest bits that the
vocabulary needs. Ids come in blocks of BLOCK that start at byte boundaries; the footer has the byte
offset of each block and the first id of each document, so any document or id range is read by
seeking to its blocks and unpacking them with numpy. Layout, little-endian:

    packed blocks | block offsets u64[blocks + 1] | doc ids i64[docs] | doc is null u8[docs]
    | doc starts u64[docs + 1] | trailer: footer offset u64, ids u64, docs u64, bits u32, block u32, MAGIC
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.scan import buffers, hashes, pieces
from spendlake.llm.shared import filesystem, spread, stored, text_key

MAGIC = b"TOKBITS1"
TRAILER = struct.Struct("<QQQII8s")
BLOCK = 8192
END_ID = 2
#: Bytes of text that are encoded together.
PIECE = 1 << 20
#: Pieces that a Python worker remembers before it starts anew.
CACHE = 500_000


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = planes
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Appends documents to one file; only the current block and the footer are in memory."""

    def __init__(self, sink, bits: int) -> None:
        self.sink, self.bits, self.rest, self.n = sink, bits, [], 0
        self.offsets, self.docs, self.starts = [0], [], [0]
        self.pending = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents whose ids stand in a row in ``ids``."""
        self.docs += doc_ids
        self.starts += (self.n + np.cumsum(sizes)).tolist()
        self.n += len(ids)
        self.rest.append(ids)
        self.pending += len(ids)
        if self.pending >= 8 * BLOCK:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if end else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            block = pack(ids[at : min(at + BLOCK, whole)], self.bits)
            self.sink.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
        self.rest, self.pending = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.sink.write(np.array([d is None for d in self.docs], "u1").tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(TRAILER.pack(self.offsets[-1], self.n, len(self.docs), self.bits, BLOCK, MAGIC))


class Reader:
    """Random access to one file: ``ids(start, stop)`` reads only the blocks it needs."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        footer, self.n, docs, self.bits, self.block, magic = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        blocks = -(-self.n // self.block)
        tail = source.read_at(size - TRAILER.size - footer, footer)
        self.offsets = np.frombuffer(tail, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        self.docs = np.frombuffer(tail, "<i8", docs, at)
        self.null = np.frombuffer(tail, "u1", docs, at + 8 * docs).astype(bool)
        self.starts = np.frombuffer(tail, "<u8", docs + 1, at + 9 * docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        n = min((last + 1) * self.block, self.n) - first * self.block
        return unpack(data, self.bits, n)[start - first * self.block : stop - first * self.block]


class Encoder:
    """Encodes texts with the tokenizers library, piece by piece, and remembers the pieces.

    A byte-level vocabulary of this kind splits a text before it merges, and no part goes on over a
    single blank or line feed between two other characters. So the ids of a text are those of the
    pieces that such places separate, one after the other. Beside a character whose class a
    byte does not tell, a text is simply not cut. A new piece goes through the library's splitting
    (an ASCII pattern of the same meaning where that is exact) and its merges. Texts with the string of a
    special token, and vocabularies of another kind, go through ``encode`` whole.
    """

    #: The splitting pattern of the vocabulary, for pieces whose letters are all in LATIN.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+")
    LATIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ɏ]*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, model = kind.get("pre_tokenizer") or {}, kind["model"]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are remembered here
        self.specials = [t["content"].encode() for t in kind.get("added_tokens", [])]
        self.by_piece = (
            (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and (model["type"], model.get("dropout"), model.get("unk_token")) == ("BPE", None, None)
            and not kind.get("normalizer")
        )
        # the printable stand-ins of bytes: their own characters where printable, else those from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        self.stand_in = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.blank = self.stand_in[0x20]
        self.forget()

    def forget(self) -> None:
        #: hashes of known pieces, sorted; where the ids of each begin in the pool, and how many they are
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _piece(self, piece: bytes) -> list[int]:
        text, merge = piece.decode(), self.tokenizer.model.tokenize
        if text[1:].isalpha() and text.isascii() and (text[0] == " " or text[0].isalpha()):
            return [t.id for t in merge(text.replace(" ", self.blank))]
        if self.LATIN.fullmatch(text):
            parts = [x.encode().decode("latin-1").translate(self.stand_in) for x in self.PARTS.findall(text)]
        else:
            parts = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return [t.id for part in parts for t in merge(part)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids before each text and of all)."""
        raw = data.tobytes()
        if not self.by_piece or any(s in raw for s in self.specials):
            texts = [raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.cumsum([0, *map(len, got)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = self._bounds(data, offsets)
        hashed = hashes(data, bounds[:-1], bounds[1:])
        codes, unique = pd.factorize(hashed)
        if len(self.hash) > CACHE:
            self.forget()
        if len(self.hash):
            where = np.minimum(np.searchsorted(self.hash, unique), len(self.hash) - 1)
            new = np.flatnonzero(self.hash[where] != unique)
        else:
            new = np.arange(len(unique))
        if len(new):
            first = np.zeros(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            self._learn(unique[new], [self._piece(raw[a:b]) for a, b in zip(bounds[first[new]].tolist(), bounds[first[new] + 1].tolist())])
            where = np.searchsorted(self.hash, unique)
        size = self.size[where][codes]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[where][codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(bounds, offsets)]

    def _learn(self, hashed: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids])
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        order = np.argsort(hashed)
        into = np.searchsorted(self.hash, hashed[order])
        self.hash, self.at, self.size = (np.insert(old, into, new[order]) for old, new in ((self.hash, hashed), (self.at, at), (self.size, sizes)))

    @staticmethod
    def _bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end of the last."""
        kind = _KIND[data]
        before = kind == 1
        before[1:] |= (kind[1:] == 2) & (kind[:-1] == 3)  # the end of a letter of two bytes
        ahead = (kind == 1) | (kind == 3)
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            inner = np.flatnonzero((kind[1:-1] >= 4) & before[:-2] & ahead[2:]) + 1
            cut[inner] = True
            cut[inner[data[inner] == 0x0A] + 1] = True
            edge = offsets[(offsets > 0) & (offsets < len(data))]  # what stands in another text decides nothing
            for d in (-1, 0):
                cut[edge + d] = False
            late = edge[edge + 1 < len(data)] + 1
            cut[late[data[late - 1] == 0x0A]] = False
        cut[offsets] = True
        return np.flatnonzero(cut)


#: Kinds of bytes: 1 ASCII but no white space, 2 inside a character, 3 first of a letter of two bytes, 4 blank, 5 line feed.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[0x80:0xC0], _KIND[0xC3:0xCA], _KIND[0x20], _KIND[0x0A] = 1, 2, 3, 4, 5


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


MANIFEST = "origin string, row bigint, shard int, file string, bits int, n_docs bigint, n_ids bigint"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files below ``path``, in ascending order of doc_id; returns and stores the manifest.

    Files are ranges of doc_id, null first, equal ids in the order of a hash of their texts; ``start``
    in the manifest is the number of ids in the files before. A null text is empty: its document
    is the end id alone. Repeated rows are documents of their own. An empty table gives no file.
    Other columns are not read. A task writes a file under a new name, so a repeated attempt
    leaves at most a file that no manifest names.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(text_key("text")).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return _write(ordered.select("doc_id", "text", F.lit("").alias("origin"), F.lit(0).cast("bigint").alias("row")), path, tokenizer, end_id)


def write_stored(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """As ``write``, in the order in which ``docs`` are stored: by the names of their files, and rows as they stand in a file.

    No row is shuffled: a part of a file that a task reads becomes a token file. Documents that do not come from Parquet files are stored first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, "ordered")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_path").alias("origin"), F.col("_metadata.row_index").alias("row"))
    return _write(rows, path, tokenizer, end_id)


def _write(rows: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Token files of ``rows`` (doc_id, text, origin, row) as they come; rows of another origin, or not next to those before, begin another file."""
    spark = rows.sparkSession
    schema = pa.schema([("origin", pa.string()), ("row", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("bits", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(tokenizer), TaskContext.get().partitionId()
        bits = width(max(code.tokenizer.get_vocab_size(), end_id + 1))
        fs, folder = filesystem(path)
        writer = sink = entry = None

        def finished() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist([entry | {"n_docs": len(writer.docs), "n_ids": writer.n}], schema=schema)

        for batch in batches:
            origin, row = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            change = [k for k in range(1, batch.num_rows) if origin[k] != origin[k - 1] or not 0 <= row[k] - row[k - 1] <= 1]
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if a == b:
                    continue
                if writer is None or (origin[a], int(row[a])) not in (after, (after[0], after[1] - 1)):
                    if writer is not None:
                        yield finished()
                    fs.create_dir(folder, recursive=True)
                    entry = {"origin": origin[a], "row": int(row[a]), "shard": shard, "file": f"ids-{shard:06d}-{uuid.uuid4().hex}.tok", "bits": bits}
                    sink = fs.open_output_stream(f"{folder}/{entry['file']}")
                    writer = Writer(sink, bits)
                after = (origin[b - 1], int(row[b - 1]) + 1)
                run = batch.slice(a, b - a)
                ids = run.column(0).to_pylist()
                for first, stop, data, offsets in pieces(*buffers(run.column(1)), PIECE):
                    got, before = code.encode(data, offsets)
                    writer.add(ids[first:stop], np.insert(got, before[1:], end_id), np.diff(before) + 1)
        if writer is not None:
            yield finished()

    rows.mapInArrow(task, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per token file below ``path``: its place, name, bits, counts and the ids before it."""
    # a row per file; the window needs them in one task
    before = Window.orderBy("origin", "row", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the token files below ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over the ids as unsigned
    little-endian 32-bit integers. A task reads a file in runs of documents of some blocks.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else [])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{folder}/{name}") as source:
                    yield from _documents(Reader(source), before, with_ids, pa.schema(kinds))

    files = manifest(spark, path).select("file", "start", "n_ids", "bits")
    return spread(files, "n_ids * bits div 8", "file").select("file", "start").mapInArrow(task, schema)


def _documents(file: Reader, before: int, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    first, n = 0, len(file.docs)
    while first < n:
        end = max(first + 1, int(np.searchsorted(file.starts, file.starts[first] + 64 * BLOCK, side="right")) - 1)
        end = min(end, n)
        ids = file.ids(int(file.starts[first]), int(file.starts[end]))
        cuts = file.starts[first : end + 1] - file.starts[first]
        raw = memoryview(ids.tobytes())
        columns = [
            pa.array(file.docs[first:end], mask=file.null[first:end]),
            pa.array(file.starts[first:end] + before),
            pa.array(np.diff(cuts)),
            pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.int64()),
        ]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        first = end
