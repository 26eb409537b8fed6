"""Token counts of documents in flat, unindexed token files.

A flat file is nothing but fixed-width ids; a document ends with a separator id. The stream of all files is cut
into blocks that are searched on their own, each with one vectorised comparison. A running maximum of the last
separator over the blocks before (a prefix scan, inside each file first and then over the files) then tells where the first
document of a block began, however many blocks it crosses.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.scan import buffers, pieces
from spendlake.llm.shared import filesystem, spread, stored
from spendlake.llm.token_files import PIECE, encoder

#: Ids of a block.
BLOCK = 1 << 18
FILES = "shard int, file string, width int, n_ids bigint"


def write_flat(docs: DataFrame, path: str, tokenizer: str) -> int:
    """Write ``docs`` (text) as flat files below ``path``, without a shuffle; returns the separator.

    The separator is the first id beyond the vocabulary, so no text contains it. A null text is empty.
    """
    end = encoder(tokenizer).tokenizer.get_vocab_size()
    width = 2 if end < 1 << 16 else 4

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, sink, n, name = encoder(tokenizer), TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            for _, _, data, offsets in pieces(*buffers(batch.column(0)), PIECE):
                if sink is None:
                    fs, folder = filesystem(path)
                    fs.create_dir(folder, recursive=True)
                    name = f"flat-{shard:06d}-{uuid.uuid4().hex}.bin"
                    sink = fs.open_output_stream(f"{folder}/{name}")
                got, before = code.encode(data, offsets)
                got = np.insert(got, before[1:], end)
                sink.write(got.astype(f"<u{width}").tobytes())
                n += len(got)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([width], pa.int32()), pa.array([n])], names=["shard", "file", "width", "n_ids"])

    docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(task, FILES).write.parquet(f"{path}/files")
    return end


def count_tokens(spark: SparkSession, path: str, end: int, block: int = BLOCK) -> DataFrame:
    """start, n_tokens, ended of every document in the flat files below ``path``, read as one stream in the order of shards.

    ``n_tokens`` includes the separator; ids after the last separator are a document with ``ended`` false. No files give no rows.
    """
    files = spark.read.schema(FILES).parquet(f"{path}/files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))
    parts = files.where("n_ids > 0").select("shard", "file", "width", "n_ids", "base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_ids") - 1, F.lit(block).cast("bigint"))).alias("at"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for shard, file, width, n, base, at in zip(*(c.to_pylist() for c in batch.columns)):
                size = min(block, n - at)
                with fs.open_input_file(f"{folder}/{file}") as source:
                    ids = np.frombuffer(source.read_at(size * width, at * width), f"<u{width}")
                ends = np.flatnonzero(ids == end) + base + at + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([base + at]), pa.array([base + at + size]), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    names=["shard", "first", "stop", "last", "ends"],
                )

    blocks = stored(spread(parts, f"least({block}, n_ids - at) * width", "file", "at").mapInArrow(task, "shard int, first bigint, stop bigint, last bigint, ends array<bigint>"), "separators")
    small = blocks.select("shard", "first", "stop", "last")
    of_files = small.groupBy(F.col("shard").alias("in_shard")).agg(F.max("last").alias("last"))  # a row per file
    of_files = of_files.select("in_shard", F.max("last").over(Window.orderBy("in_shard").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    scan = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    known = small.withColumn("within", F.max("last").over(scan)).join(of_files, F.col("shard") == F.col("in_shard"))
    known = known.select(F.col("first").alias("of"), F.coalesce("within", "earlier", F.lit(0).cast("bigint")).alias("open"))
    found = blocks.join(known, F.col("first") == F.col("of"))
    starts = F.concat(F.array("open"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    whole = found.where("size(ends) > 0").withColumn("starts", starts).select(F.explode(F.arrays_zip("starts", "ends")).alias("d"))
    whole = whole.select(F.col("d.starts").alias("start"), (F.col("d.ends") - F.col("d.starts")).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = small.agg(F.coalesce(F.max("last"), F.lit(0).cast("bigint")).alias("start"), F.max("stop").alias("stop")).where("stop > start")
    return whole.unionAll(rest.select("start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False)))
