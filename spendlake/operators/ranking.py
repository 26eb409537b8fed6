"""Ranking inside a key without pulling a hot key into one task.

``top_k`` keeps the shape ``row_number() <= k`` which Catalyst turns into a
WindowGroupLimit on both sides of the shuffle: each map task sends at most k
rows per key. ``bucketed_rank`` gives exact ranks of any depth: rows are ranked
inside a time bucket of the key, and bucket offsets come from a small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_limit_threshold(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    """``top_k``, or every row with its rank where ``k`` is None."""
    if k is not None:
        return top_k(df, keys, order, k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def bucketed_rank(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[Column],
    descending: bool = True,
    bucket: str = "hour",
    rank: str = "rank",
) -> DataFrame:
    """Exact row_number over ``keys`` ordered by time (then ``order``), any depth.

    No task holds more than one time bucket of one key. Rows without a time are
    a bucket of their own, last where newer rows come first.
    """
    rows = df.withColumn("_b", F.date_trunc(bucket, F.col(ts).cast("timestamp")))
    b = F.col("_b").desc() if descending else F.col("_b").asc()
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        join_null_safe(rows, offsets, [*keys, "_b"])
        .withColumn(rank, F.row_number().over(inside) + F.col("_before"))
        .drop("_b", "_before")
    )


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of every user's rows, newest first."""
    order = [F.col("transaction_date").desc(), F.col("created_at").desc(), F.col("txn_id").desc()]
    last = number * size
    if last <= group_limit_threshold(df):
        ranked = top_k(df, ["user_id"], order, last)
    else:
        ranked = bucketed_rank(df, ["user_id"], "transaction_date", order)
        ranked = ranked.filter(F.col("rank") <= last)
    return ranked.filter(F.col("rank") > last - size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """Totals of the paged list per user."""
    pages = F.ceil(F.col("total") / F.lit(size))
    return (
        df.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total"))
        .select(
            "user_id",
            "total",
            F.lit(number).alias("page"),
            F.lit(size).alias("limit"),
            pages.alias("pages"),
            (F.lit(number) < pages).alias("has_next"),
            F.lit(number > 1).alias("has_prev"),
        )
    )


def half_split_trend(
    df: DataFrame,
    keys: Sequence[str],
    up: float = 1.15,
    down: float = 0.85,
    ts: str = "transaction_date",
    amount: str = "amount",
    tie: str = "txn_id",
) -> DataFrame:
    """Mean of the later half of a key's rows against the earlier half.

    Rows are first reduced to (count, sum) per day. Only the rows of the one
    day that contains the split are ranked, so a hot key costs an aggregate,
    not a sort of all its rows. Fewer than 4 rows is stable; the middle row of
    an odd count belongs to the later half.
    """
    rows = df.select(*keys, F.to_date(ts).alias("_day"), ts, F.col(amount).alias("_amount"), F.col(tie).alias("_tie"))
    per_day = rows.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_s"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    days = (
        per_day.withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_cum", F.sum("_n").over(upto))
        .withColumn("_mid", F.floor(F.col("_total") / 2))
        .withColumn("_take", F.col("_mid") - (F.col("_cum") - F.col("_n")))
        .filter(F.col("_total") > 1)
    )
    summary = days.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        F.max("_mid").alias("_mid"),
        F.sum("_s").alias("_sum"),
        F.sum(F.when(F.col("_cum") <= F.col("_mid"), F.col("_s"))).alias("_whole_days"),
    )
    split = days.filter((F.col("_cum") > F.col("_mid")) & (F.col("_take") > 0)).select(*keys, "_day", "_take")
    inside = Window.partitionBy(*keys, "_day").orderBy(ts, "_tie")
    partial = (
        rows.join(split, [*keys, "_day"])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") <= F.col("_take"))
        .groupBy(*keys)
        .agg(F.sum("_amount").alias("_split_day"))
    )
    zero = F.lit(0).cast("decimal(15,2)")
    first = F.coalesce(F.col("_whole_days"), zero) + F.coalesce(F.col("_split_day"), zero)
    first_mean = first.cast("double") / F.col("_mid")
    later_mean = (F.col("_sum") - first).cast("double") / (F.col("_total") - F.col("_mid"))
    trend = (
        F.when(F.col("_total") < 4, "stable")
        .when(later_mean > first_mean * up, "up")
        .when(later_mean < first_mean * down, "down")
        .otherwise("stable")
    )
    return summary.join(partial, list(keys), "left").select(*keys, trend.alias("trend"))
