"""What several operators need: places for written tables, column hygiene, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from spendlake.session import checkpoint_dir, checkpointed


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the folder that ``spark.checkpoint.dir`` names, which all executors share."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage is cut and later readers share the work."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges that a task returns at a time.
ROWS = 1 << 16
#: Bytes of files that one task reads.
TASK = 64 << 20


def spread(parts: DataFrame, size: str, *keys: str) -> DataFrame:
    """Rows that name parts of files, ``size`` bytes each, dealt over tasks of about TASK bytes, or fewer where cores would idle.

    The number of partitions is given, so adaptive execution does not merge them: the rows are small, what they name is not.
    """
    n, total = parts.agg(F.count("*"), F.sum(F.expr(size))).first()
    cores = parts.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(max(1, min(n, max((total or 0) // TASK, 4 * cores))), *keys)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder that Spark names by a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = uri.removeprefix("file:")
        uri = "/" + uri.lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to give to its own results."""
    return df.drop(*names)


def text_key(column: str) -> F.Column:
    """A column as text, a null as the empty text: the form in which keys are hashed."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bits of a sieve, a power of two.
SIEVE = 1 << 25


def sieve(keys: DataFrame, bits: int = SIEVE) -> Callable[[F.Column], F.Column]:
    """A test of a bigint column: true for the values of ``keys`` (one bigint column, no nulls), and for few others as long as these are few beside ``bits``.

    A Bloom filter of ``bits`` bits and two hashes, whatever the input; the driver gets its words that are not zero. Rows that it leaves out need no shuffle
    to be told apart from ``keys``; where it is full it leaves out none, so what it lets through must be joined still.
    """
    hashed = F.xxhash64(F.col(keys.columns[0]))
    places = keys.select(F.explode(F.array(hashed.bitwiseAND(bits - 1), F.shiftrightunsigned(hashed, 32).bitwiseAND(bits - 1))).alias("place"))
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    found = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    words = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(BooleanType())
    def inside(hashed: pd.Series) -> pd.Series:
        h = hashed.to_numpy().view(np.uint64)
        held = np.ones(len(h), bool)
        for place in (h & np.uint64(bits - 1), h >> np.uint64(32) & np.uint64(bits - 1)):
            held &= (words.value[place >> np.uint64(6)] >> (place & np.uint64(63)).astype(np.int64) & 1).astype(bool)
        return pd.Series(held)

    return lambda column: inside(F.xxhash64(column))


class Forest:
    """Union-find over ``0..n-1`` whose unions come as arrays; every label is the smallest member."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        differ = a != b
        while differ.any():
            a, b = a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = self.label[self.label]
                if (jumped == self.label).all():
                    break
                self.label = jumped
            a, b = self.label[a], self.label[b]
            differ = a != b


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Alternating large-star and small-star rounds: every round points the neighbours of a node at
    the smallest of them, so trees become stars in a logarithmic number of rounds. A round is two
    aggregations with map-side combine and two joins on the node, which Spark splits where a hub is
    hot; no neighbourhood is ever collected. Every round is checkpointed, each of its partitions as
    the stars of its own edges; the rounds end when all edges are stars. Nulls and self-links are ignored.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        ends = np.concatenate([held["a"].to_numpy(), held["b"].to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        forest = Forest(len(nodes))
        forest.union(at[: len(held)], at[len(held) :])
        for rows in np.array_split(np.flatnonzero(forest.label != np.arange(len(nodes))), len(nodes) // ROWS + 1):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array(nodes[forest.label[rows]])], names=["a", "b"])

    def reduced(edges: DataFrame) -> DataFrame:
        return checkpointed(edges.distinct().mapInArrow(stars, "a bigint, b bigint"))

    edges = reduced(edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).where("a <> b"))
    while True:
        ends = edges.select("a", F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        if ends.where("child + root > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct().toDF("node", "component")
            )
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).where("a <> b")
        edges = reduced(small)
