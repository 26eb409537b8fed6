"""Duplicate transactions: by content key, by similarity, greedy removal.

Rows are compared inside blocks: (scope, direction, run of days, run of
amounts), where rows of different blocks are never alike. The first ``HEAD``
rows of a block are compared pair by pair. Later rows come in batches, each as
large as all before it: the rows of a batch look for their partners among the
rows not decided yet, and what they find leaves. A group of similar rows is so
gone after its first batch, and a block of n rows takes log2(n / HEAD) rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.text import transaction_key
from spendlake.operators.ranking import first_per_key
from spendlake.session import checkpointed

#: Rows at the beginning of a block that are compared pair by pair.
HEAD = 64
#: Rows of large blocks in one task while they are numbered.
PART = 200_000


def with_key(df: DataFrame) -> DataFrame:
    key = transaction_key(F.to_date("transaction_date"), F.col("amount"), F.col("transaction_type"), F.col("description"))
    return df.withColumn("key", key)


def first_occurrences(df: DataFrame, order: Sequence[Column], scope: Sequence[str] = ()) -> DataFrame:
    """First row per content key; a key with very many copies sends few rows per task."""
    return first_per_key(with_key(df), [*scope, "key"], order)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters as difflib counts it; Spark has no equivalent."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


FACTS = ["_rep", "_dno", "_cents", "_desc", "_ref"]


@dataclass(frozen=True)
class Likeness:
    """When two rows of a block are alike: days and amounts within the
    tolerances, and the same reference or texts more similar than ``threshold``.

    ``edit``: one minus the Levenshtein distance over the longer length.
    ``ratio``: difflib's ratio, for which the distance is only a bound.
    """

    days: int = 0
    cents: int = 1
    threshold: float = 0.8
    method: str = "ratio"

    def judged(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a earlier, b later) that are alike."""
        pairs = pairs.filter((F.col("a_rep") < F.col("b_rep")) & (F.abs(F.col("a_dno") - F.col("b_dno")) <= self.days))
        pairs = pairs.filter(F.abs(F.col("a_cents") - F.col("b_cents")) <= self.cents)
        same_ref = (F.col("a_ref") != "") & (F.col("a_ref") == F.col("b_ref"))
        a, b = F.length("a_desc"), F.length("b_desc")
        # Characters that a common subsequence leaves out bound the distance of alike texts.
        size = F.greatest(a, b) if self.method == "edit" else a + b
        pairs = pairs.withColumn("_most", F.floor(size * (1 - self.threshold) + 1e-6).cast("int"))
        pairs = pairs.filter(same_ref | (F.abs(a - b) <= F.col("_most")))
        distance = F.expr("levenshtein(a_desc, b_desc, _most)")
        if self.method == "edit":
            share = F.lit(1.0) - distance / F.greatest(a, b, F.lit(1))
            return pairs.filter(same_ref | ((distance >= 0) & (share > self.threshold)))
        return pairs.filter(same_ref | (distance >= 0)).filter(same_ref | (sequence_ratio("b_desc", "a_desc") > self.threshold))

    def within(self, rows: DataFrame) -> DataFrame:
        """Alike pairs of blocks of few rows."""
        rows = rows.withColumn("_hash", F.xxhash64("_block"))
        a, b = _side(rows, "a", ["_hash", "_block"]), _side(rows, "b", ["_hash", F.col("_block").alias("b_block")])
        return self.judged(a.join(b, "_hash").filter(F.col("_block") == F.col("b_block")).drop("_hash", "b_block"))

    def across(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Alike pairs of earlier rows in ``left`` and later rows in ``right``.

        Rows meet in cells of day and amount. With ``edit`` they also have to
        share a segment: a text that k edits turn into another, cut into k + 1
        segments, has one that no edit touched, and it stands in the other text
        at a place that the lengths and k bound. Segments are met by their
        hashes; pairs are judged on the texts.
        """
        a, b = self._celled(left, near=True), self._celled(right, near=False)
        if self.method == "edit":
            refs = lambda df: df.filter("_ref != ''").withColumn("_key", F.xxhash64("_block", "_dc", "_cc", "_ref"))
            keyed = lambda df, made: made.unionByName(refs(df).select(made.columns)).distinct()
            met = keyed(a, self._probes(a)).toDF("_block", "a_rep", "_key").join(
                keyed(b, self._segments(b)).toDF("b_block", "b_rep", "_key"), "_key"
            )
            met = met.filter((F.col("_block") == F.col("b_block")) & (F.col("a_rep") < F.col("b_rep"))).select("_block", "a_rep", "b_rep").distinct()
            return self.judged(met.join(_side(left, "a"), ["_block", "a_rep"]).join(_side(right, "b"), ["_block", "b_rep"]))
        cell = ["_block", "_dc", "_cc"]
        return self.judged(_side(a, "a", cell).join(_side(b, "b", cell), cell))

    def _celled(self, rows: DataFrame, near: bool) -> DataFrame:
        """Cells so wide that all partners of a row lie in two at most."""
        for name, column, reach in (("_dc", "_dno", self.days), ("_cc", "_cents", self.cents)):
            cell = lambda by: F.floor((F.col(column) + by) / (2 * reach + 1))  # noqa: B023, E731
            rows = rows.withColumn(name, F.explode(F.array_distinct(F.array(cell(-reach), cell(reach)))) if near else cell(0))
        return rows

    def _edits(self, longer: str) -> str:
        return f"CAST(floor(({longer}) * {1 - self.threshold!r} + 1e-6) AS INT)"

    def _segments(self, rows: DataFrame) -> DataFrame:
        """Texts cut for every number of edits that a partner may take."""
        cut = (
            rows.withColumn("_l", F.length("_desc"))
            .withColumn("_p", F.expr(f"explode(array_distinct(transform(sequence(_l, CAST(floor(_l / {self.threshold!r} + 1e-6) AS INT)), x -> {self._edits('x')} + 1)))"))
            .withColumn("_i", F.expr("explode(sequence(0, _p - 1))"))
            .withColumn("_at", F.expr("CAST(_i * _l div _p AS INT)"))
        )
        return cut.select("_block", "_rep", self._key())

    def _probes(self, rows: DataFrame) -> DataFrame:
        """Substrings of a text where a segment of a partner of length ``_l`` may stand."""
        lengths = f"explode(sequence(CAST(ceil(_n * {self.threshold!r} - 1e-6) AS INT), CAST(floor(_n / {self.threshold!r} + 1e-6) AS INT)))"
        shifts = "sequence(-CAST((_k - (_n - _l)) div 2 AS INT), CAST((_k + (_n - _l)) div 2 AS INT))"
        probes = (
            rows.withColumn("_n", F.length("_desc")).withColumn("_l", F.expr(lengths))
            .withColumn("_k", F.expr(self._edits("greatest(_n, _l)"))).filter("abs(_n - _l) <= _k")
            .withColumn("_p", F.col("_k") + 1).withColumn("_i", F.expr("explode(sequence(0, _p - 1))"))
            .withColumn("_at", F.expr(f"explode(transform({shifts}, x -> x + CAST(_i * _l div _p AS INT)))"))
            .filter("_at >= 0 AND _at + ((_i + 1) * _l div _p - _i * _l div _p) <= _n")
        )
        return probes.select("_block", "_rep", self._key())

    @staticmethod
    def _key() -> Column:
        piece = F.expr("substring(_desc, _at + 1, CAST((_i + 1) * _l div _p - _i * _l div _p AS INT))")
        return F.xxhash64("_block", "_dc", "_cc", "_l", "_p", "_i", piece).alias("_key")


def _side(rows: DataFrame, name: str, keys: Sequence[str | Column] = ("_block",)) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(name + c) for c in FACTS])


def _whole(df: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, Column]:
    """Columns that decide whether rows are duplicates, and which rows have all that are needed."""
    ref = F.col("reference") if "reference" in df.columns else F.lit(None).cast("string")
    rows = (
        df.withColumn("_dno", F.unix_date(F.to_date("transaction_date")))
        .withColumn("_cents", F.round(F.col("amount").cast("decimal(20,4)") * 100, 0).cast("bigint"))
        .withColumn("_desc", F.lower(F.coalesce("description", F.lit(""))))
        .withColumn("_ref", F.coalesce(F.nullif(ref, F.lit("")), F.lit("")))
    )
    needed = [F.col(c).isNotNull() for c in (*scope, "transaction_type", "_dno", "_cents")]
    return rows, reduce(lambda x, y: x & y, needed)


def _runs(rows: DataFrame, group: Sequence[str], column: str, gap: int, name: str) -> DataFrame:
    """``rows`` with the number of their run: values without a step above ``gap``."""
    steps = Window.partitionBy(*group).orderBy(column)
    step = F.col(column) - F.lag(column).over(steps)
    values = rows.select(*group, column).distinct().withColumn("_new", F.when(step <= gap, 0).otherwise(1))
    return rows.join(values.withColumn(name, F.sum("_new").over(steps)).drop("_new"), [*group, column])


def _blocked(reps: DataFrame, group: Sequence[str], like: Likeness) -> DataFrame:
    days = _runs(reps, group, "_dno", like.days, "_span") if like.days else reps.withColumn("_span", F.col("_dno"))
    runs = _runs(days, [*group, "_span"], "_cents", like.cents, "_run")
    return runs.select(F.struct(*group, "_span", "_run").alias("_block"), *FACTS)


def _batched(rows: DataFrame, reps: DataFrame, scope: Sequence[str], like: Likeness, head: int) -> tuple[DataFrame, DataFrame | None, int]:
    """First rows of all blocks, the numbered rows of the large ones, their last batch.

    Where few rows share scope, direction and day they are a block as they are.
    """
    group = [*scope, "transaction_type"]
    part = [*group, *([] if like.days else ["_dno"])]
    full = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > head).drop("_n")
    span = F.lit(0).cast("int") if like.days else F.col("_dno")
    loose = F.struct(*group, span.alias("_span"), F.lit(0).cast("bigint").alias("_run")).alias("_block")
    if full.isEmpty():
        return reps.select(loose, *FACTS), None, 0
    few = reps.join(full, part, "left_anti").select(loose, *FACTS)
    blocked = checkpointed(_blocked(reps.join(full, part, "left_semi"), group, like))
    few = few.withColumn("_block", F.col("_block").cast(blocked.schema["_block"].dataType))
    sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    sized = blocked.join(sizes, "_block")
    total = sizes.filter(F.col("_n") > head).agg(F.sum("_n")).first()[0]
    if not total:
        return few.unionByName(blocked), None, 0
    # The checkpoint fixes the partitions that the numbers build on.
    placed = sized.filter(F.col("_n") > head).drop("_n").repartitionByRange(-(-total // PART), "_block", "_rep")
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_block", "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_block", "_part").orderBy("_rep")) - 1 + F.col("_before")
    batch = lambda r: F.when(r < head, 0).otherwise(F.floor(F.log2(r / head)) + 1).cast("int")
    numbered = placed.join(starts, ["_block", "_part"]).withColumn("_batch", batch(rank))
    large = checkpointed(numbered.select("_block", *FACTS, "_batch"))
    first = sized.filter(F.col("_n") <= head).drop("_n").unionByName(large.filter("_batch = 0").drop("_batch"))
    return few.unionByName(first), large, large.agg(F.max("_batch")).first()[0]


def _later(pairs: DataFrame) -> DataFrame:
    return pairs.select("_block", F.col("b_rep").alias("_rep")).distinct()


def near_duplicates(
    df: DataFrame,
    scope: Sequence[str] = ("user_id",),
    days: int = 0,
    cents: int = 1,
    threshold: float = 0.8,
    method: str = "edit",
    head: int = HEAD,
) -> DataFrame:
    """For every duplicate row, the first earlier row it duplicates.

    Equal rows are one representative from the start, so a group of copies
    costs an aggregate. A row of a large block leaves with its first partner,
    as batches come in the order of the rows.
    """
    like = Likeness(days, cents, threshold, method)
    rows, whole = _whole(df, scope)
    rows = rows.filter(whole)
    same = [*scope, "transaction_type", *FACTS[1:]]
    reps = rows.groupBy(*same).agg(F.min("txn_id").alias("_rep"))
    first, large, last = _batched(rows, reps, scope, like, head)
    earliest = lambda pairs: pairs.groupBy("_block", F.col("b_rep").alias("_rep")).agg(F.min("a_rep").alias("_first"))
    found = [earliest(like.within(first))]
    if large is not None:
        waiting = large.filter("_batch > 0")
        for k in range(last + 1):
            now = checkpointed(earliest(like.across(large.filter(F.col("_batch") == k).drop("_batch"), waiting)))
            found.append(now)
            waiting = checkpointed(waiting.join(now, ["_block", "_rep"], "left_anti").filter(F.col("_batch") > k))
            if waiting.isEmpty():
                break
    matched = reduce(DataFrame.unionByName, found).select(*[F.col(f"_block.{c}").alias(c) for c in (*scope, "transaction_type")], "_rep", "_first")
    known = rows.join(reps, same).join(matched, [*scope, "transaction_type", "_rep"], "left")
    duplicate_of = F.coalesce("_first", F.when(F.col("txn_id") != F.col("_rep"), F.col("_rep")))
    return known.select("txn_id", duplicate_of.alias("duplicate_of")).filter("duplicate_of IS NOT NULL")


def remove_duplicates(
    df: DataFrame,
    scope: Sequence[str] = ("user_id",),
    order: str = "txn_id",
    threshold: float = 0.8,
    cents: int = 1,
    days: int = 0,
    method: str = "ratio",
    head: int = HEAD,
) -> DataFrame:
    """Greedy removal in ``order``: a row goes if it is like an earlier kept row.

    Adds ``is_kept``, as one pass over the rows would. Equal rows share the
    fate of the first, which alone may be kept. The first rows of a block are
    decided by a fold over their pairs; a later batch by a fixpoint over its
    pairs, after which its kept rows remove their partners from all rows to come.

    A row without a scope, direction, day or amount is like no other and stays.
    ``order`` is an integer, and no two rows of a scope share one.
    """
    like = Likeness(days, cents, threshold, method)
    rows, whole = _whole(df, scope)
    loose = rows.filter(~whole).select(*df.columns, F.lit(True).alias("is_kept"))
    rows = rows.filter(whole)
    same = [*scope, "transaction_type", *FACTS[1:]]
    reps = rows.groupBy(*same).agg(F.min(order).cast("bigint").alias("_rep"))
    first, large, last = _batched(rows, reps, scope, like, head)
    gone = _folded(like.within(first))
    if large is not None:
        gone = checkpointed(gone)
        gone = gone.unionByName(_rest(large, last, gone, like))
    gone = gone.select(*[F.col(f"_block.{c}").alias(c) for c in (*scope, "transaction_type")], "_rep", F.lit(True).alias("_gone"))
    fate = rows.join(reps, same).join(gone, [*scope, "transaction_type", "_rep"], "left")
    stays = F.col("_gone").isNull() & (F.col(order) == F.col("_rep"))
    return fate.withColumn("is_kept", stays).select(*df.columns, "is_kept").unionByName(loose)


def _folded(pairs: DataFrame) -> DataFrame:
    """Rows that go in blocks of few rows: those with an earlier partner that has not gone."""
    partners = pairs.groupBy("_block", F.col("b_rep").alias("rep")).agg(F.collect_set("a_rep").alias("earlier"))
    listed = partners.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("rep", "earlier"))).alias("later"))
    left_over = lambda gone, row: F.size(F.array_except(row["earlier"], gone)) > 0
    step = lambda gone, row: F.when(left_over(gone, row), F.array_append(gone, row["rep"])).otherwise(gone)
    none = F.array().cast("array<bigint>")
    return listed.select("_block", F.explode(F.aggregate("later", none, step)).alias("_rep"))


def _rest(large: DataFrame, last: int, gone: DataFrame, like: Likeness) -> DataFrame:
    """Rows behind the heads that go."""
    key = ["_block", "_rep"]
    kept_heads = large.filter("_batch = 0").drop("_batch").join(gone, key, "left_anti")
    pool = large.filter("_batch > 0")
    out = [checkpointed(_later(like.across(kept_heads, pool)))]
    for k in range(1, last + 1):
        pool = checkpointed(pool.join(out[-1], key, "left_anti").filter(F.col("_batch") >= k))
        if pool.isEmpty():
            break
        now = pool.filter(F.col("_batch") == k)
        pairs = checkpointed(like.across(now.drop("_batch"), pool).select("_block", "a_rep", "b_rep"))
        inside = pairs.join(now.select("_block", F.col("_rep").alias("b_rep")), ["_block", "b_rep"], "left_semi")
        lost = _fixpoint(inside)
        kept_pairs = pairs.join(lost.withColumnRenamed("_rep", "a_rep"), ["_block", "a_rep"], "left_anti")
        out.append(checkpointed(_later(kept_pairs)))
    return reduce(DataFrame.unionByName, out)


def _fixpoint(pairs: DataFrame) -> DataFrame:
    """Rows that go, given all pairs among them: a row without an undecided
    earlier partner stays, its partners go, until no pair is left."""
    a, b = ["_block", "a_rep"], ["_block", "b_rep"]
    live, out = pairs, [_later(pairs.filter("false"))]
    while not live.isEmpty():
        stay = live.select(*a).distinct().join(live.select("_block", F.col("b_rep").alias("a_rep")), a, "left_anti")
        go = checkpointed(_later(live.join(stay, a, "left_semi")))
        out.append(go)
        live = checkpointed(
            live.join(go.withColumnRenamed("_rep", "b_rep"), b, "left_anti").join(go.withColumnRenamed("_rep", "a_rep"), a, "left_anti")
        )
    return reduce(DataFrame.unionByName, out)


def without_repeated_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed statement rows without near duplicates in their file: (rows, messages per file that lost some)."""
    flagged = remove_duplicates(parsed.withColumn("transaction_date", F.col("date").cast("timestamp")), ("file",), "line_no")
    n = F.count(F.lit(1)).cast("string")
    messages = removed(flagged).groupBy("file").agg(F.array(F.concat(F.lit("Removed "), n, F.lit(" duplicate transactions"))).alias("warnings"))
    return kept(flagged).select(parsed.columns), messages


def kept(flagged: DataFrame) -> DataFrame:
    return flagged.filter("is_kept").drop("is_kept")


def removed(flagged: DataFrame) -> DataFrame:
    return flagged.filter("NOT is_kept").drop("is_kept")
