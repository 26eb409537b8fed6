"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= c are the pairs within t = sqrt(2 - 2c) of each other. Pivots cut the vectors
into cells, and a vector is copied to every other cell that can hold one of its partners; cells then
join on their own. Two kinds of cells:

* a core cell holds the vectors within t / 2 of a dense pivot. By the triangle inequality all its pairs are
  links, so they are counted and never compared;
* a bulk cell holds the other vectors that are nearest to its pivot.

A vector x meets cell j if d(x, pivot j) <= radius of j + t and, for a bulk cell, if x is at most t beyond the
bisecting plane between pivot j and the bulk pivot nearest to x. Both follow from the triangle inequality, so no
link is lost. Where vectors lie in all directions and in many dimensions, neither bound excludes much,
and the work tends to that of comparing all pairs once, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.shared import Forest, components, stored

COSINE = 0.9
#: Vectors that pivots are chosen from; the driver holds them and their products.
SAMPLE = 2048
#: Vectors of a cell that are compared in one task; larger cells are cut.
HOME = 4096
#: Most core cells.
CORES = 512
#: Float32 products this near to the threshold are decided in double precision: four rounding errors for each dimension, BAND at least.
BAND = 1e-5
ROUNDING = 4 * 2.0**-24
ROWS = 512


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True, initial=1e-300)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray
    cores: int  # the first points are those of core cells
    t: float

    @classmethod
    def choose(cls, sample: np.ndarray, n: int, cosine: float) -> Pivots:
        """Core pivots greedily by the number of sample vectors in reach, then one bulk pivot for HOME vectors."""
        t = float(np.sqrt(2 - 2 * cosine))
        close = sample @ sample.T >= 1 - (t / 2 * (1 - 1e-6)) ** 2 / 2
        free, cores = np.ones(len(sample), bool), []
        while len(cores) < CORES:
            reach = close[:, free].sum(axis=1)
            best = int(reach.argmax())
            if reach[best] < 3:
                break
            cores.append(best)
            free &= ~close[best]
        bulk = np.flatnonzero(free)
        bulk = (bulk if len(bulk) else np.arange(len(sample)))[: max(1, -(-n // HOME))]
        return cls(sample[[*cores, *bulk]], len(cores), t)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x @ self.points.T), 0))

    def home(self, d: np.ndarray) -> np.ndarray:
        """The cell of each vector: its nearest core pivot if that is within t / 2, else its nearest bulk pivot."""
        out = self.cores + d[:, self.cores :].argmin(axis=1)
        if self.cores:
            near = d[:, : self.cores].argmin(axis=1)
            inside = d[np.arange(len(d)), near] <= self.t / 2 * (1 - 1e-6)
            out = np.where(inside, near, out)
        return out

    def guests(self, d: np.ndarray, home: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(row, cell) mask of the other cells that a vector must meet; of two cells, one sends to the other."""
        slack = self.t + 1e-7
        meets = d <= radius + slack
        bulk = self.points[self.cores :]
        apart = np.sqrt(np.maximum(2 - 2 * (bulk @ bulk.T), 1e-12))
        nearest = d[:, self.cores :].argmin(axis=1)
        beyond = (d[:, self.cores :] ** 2 - d[np.arange(len(d)), self.cores + nearest][:, None] ** 2) / (2 * apart[nearest])
        beyond[np.arange(len(d)), nearest] = 0
        meets[:, self.cores :] &= beyond <= slack
        cell = np.arange(len(self.points))
        own, other = home[:, None], cell[None, :]
        even = (own + other) % 2 == 0
        send = np.where(other < self.cores, (own >= self.cores) | (other < own), (own >= self.cores) & (even & (own < other) | ~even & (own > other)))
        return meets & send & (own != other)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(len(column), -1)


class Cell:
    """Compares the home vectors of one task with each other and with guests; keeps counts and a forest of links."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, x: np.ndarray, cosine: float, core: bool) -> None:
        self.node, self.copies, self.x, self.cosine = node, copies, x, cosine
        self.low = x.astype(np.float32)
        self.links, self.forest = np.zeros(len(node), np.int64), Forest(len(node))
        for a in () if core else range(0, len(node), ROWS):
            linked = self._linked(x[a : a + ROWS], self.low[a : a + ROWS])
            linked[np.arange(len(linked)), a + np.arange(len(linked))] = False
            self.links[a : a + ROWS] += linked @ copies
            i, j = np.nonzero(linked)
            self.forest.union(i + a, j)

    def _linked(self, x: np.ndarray, low: np.ndarray) -> np.ndarray:
        product = low @ self.low.T
        band = max(BAND, ROUNDING * x.shape[1])
        linked = product >= self.cosine + band
        i, j = np.nonzero(~linked & (product >= self.cosine - band))
        linked[i, j] = np.einsum("ij,ij->i", x[i], self.x[j]) >= self.cosine
        return linked

    def meet(self, node: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, linked home node, linked vectors) of the guests that have a link."""
        for a in range(0, len(node), ROWS):
            linked = self._linked(x[a : a + ROWS], x[a : a + ROWS].astype(np.float32))
            self.links += copies[a : a + ROWS] @ linked
            i, j = np.nonzero(linked)
            if len(i):
                first = linked.argmax(axis=1)
                self.forest.union(first[i], j)
                some = np.flatnonzero(linked.any(axis=1))
                yield node[a + some], self.node[first[some]], linked[some] @ self.copies

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero((self.links > 0) | (self.forest.label != np.arange(len(self.node))))
        return self.node[some], self.node[self.forest.label[some]], self.links[some]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    ``n_links`` is the number of other rows with cosine >= ``cosine``; ``component_id`` the smallest vec_id that links
    reach. Vectors that are null, empty or zero, or that have a null or non-finite component, link with nothing. Of two
    lengths, the shorter vector counts as if zeros followed. Equal vectors are one node (told by a 64-bit
    hash) with a number of copies, so copies are never compared. Rows that repeat a vec_id are rows of their own;
    a null vec_id is a component of its own unless it links to others. An empty table gives an empty result. Other columns are not read.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    fine = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False),
    )
    rows = vectors.select("vec_id", F.when(fine, F.col("embedding")).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding"))
    nodes = stored(nodes, "vectors")
    n, dim = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    linked = _join(nodes, n, dim, kind, cosine) if n else None
    if linked is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = linked.groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    reach = components(linked.select("a", "b"))
    nodes = nodes.drop("embedding").join(counts, F.col("node") == F.col("of"), "left").drop("of")
    nodes = nodes.join(reach.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    nodes = stored(nodes.select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "linked")
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "component").select(F.col("node").alias("of"), "n_links", "component_id")
    out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _join(nodes: DataFrame, n: int, dim: int, kind: str, cosine: float) -> DataFrame:
    """(a, b, links) rows: the links of node a found somewhere, to be summed; and a, b are linked."""
    spark = nodes.sparkSession

    def padded(column: pa.Array) -> np.ndarray:
        flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        out = np.zeros((len(sizes), dim), kind)
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    sample = nodes.select("embedding").orderBy(F.xxhash64(F.lit(3), "node")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    pivots = spark.sparkContext.broadcast(Pivots.choose(units(padded(sample)), n, cosine))  # at most SAMPLE vectors

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = padded(batch.column(2))
            d = pivots.value.distances(units(raw)) if len(raw) else np.zeros((0, 1))
            cell = pivots.value.home(d) if len(raw) else np.zeros(0, np.int64)
            vec = pa.array([r.tobytes() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), vec], names=["node", "copies", "cell", "d", "vec"])

    placed = stored(nodes.select("node", "copies", "embedding").mapInArrow(homes, "node bigint, copies bigint, cell int, d double, vec binary"), "cells")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.sum("copies").alias("copies"), F.min("node").alias("head")).collect()}  # a row per pivot
    points, cores = len(pivots.value.points), pivots.value.cores
    radius = np.array([cells[k]["radius"] if k in cells else -9.0 for k in range(points)])
    chunks = np.array([-(-cells[k]["n"] // HOME) if k in cells else 0 for k in range(points)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                node, copies, home, _, vec = batch.slice(a, ROWS).columns
                ids, cell = node.to_numpy(), home.to_numpy().astype(np.int64)
                chunk = ids.astype(np.uint64) % chunks[cell].astype(np.uint64)
                meets = pivots.value.guests(pivots.value.distances(units(_matrix(vec, kind))), cell, radius)
                row, to = np.nonzero(meets)
                rows, tos, parts, roles = [np.arange(len(ids))], [cell], [chunk.astype(np.int64)], [np.zeros(len(ids), np.int64)]
                for part in range(int(chunks.max())):
                    own = np.flatnonzero((cell >= cores) & (part < chunks[cell]))  # the other parts of its own bulk cell
                    mine = chunk[own].astype(np.int64)
                    even = (mine + part) % 2 == 0
                    own = own[(mine != part) & (even & (mine < part) | ~even & (mine > part))]
                    there = part < chunks[to]
                    rows += [own, row[there]]
                    tos += [cell[own], to[there]]
                    parts += [np.full(len(own) + there.sum(), part)]
                    roles += [np.ones(len(own) + there.sum(), np.int64)]
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tos).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32)), pa.array(np.concatenate(roles).astype(np.int32)), node.take(take), copies.take(take), vec.take(take)],
                    names=["cell", "part", "role", "node", "copies", "vec"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], names=["a", "b", "links"])

        at, held, cell = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            role, node, copies = (batch.column(k).to_numpy() for k in (2, 3, 4))
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if place[a] != at:
                    if held:
                        yield out(*(cell or Cell(*map(np.concatenate, zip(*held)), cosine, at >> 32 < cores)).rest())
                    at, held, cell = int(place[a]), [], None
                run = (node[a:b], copies[a:b], units(_matrix(batch.column(5).slice(a, b - a), kind)))
                if role[a] == 0:
                    held.append(run)
                elif held:
                    cell = cell or Cell(*map(np.concatenate, zip(*held)), cosine, at >> 32 < cores)
                    for found in cell.meet(*run):
                        yield out(*found)
        if held:
            yield out(*(cell or Cell(*map(np.concatenate, zip(*held)), cosine, at >> 32 < cores)).rest())

    dealt = placed.mapInArrow(deal, "cell int, part int, role int, node bigint, copies bigint, vec binary")
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
    found = dealt.mapInArrow(compare, "a bigint, b bigint, links bigint")
    heads = spark.createDataFrame([(k, r["head"], r["copies"]) for k, r in cells.items() if k < cores], "cell int, head bigint, total bigint")
    inside = placed.join(F.broadcast(heads), "cell").select(F.col("node").alias("a"), F.col("head").alias("b"), (F.col("total") - F.col("copies")).alias("links"))
    return stored(found.unionAll(inside), "pairs")
