"""Operators known by their declared output: peer benchmark, recurring payments, tree, profile."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions import money as m
from spendlake.operators.analytics import is_debit
from spendlake.operators.filters import active, in_period


def peer_percentile(values: DataFrame, key: str = "category", value: str = "amount") -> DataFrame:
    """percent_rank of each row among all rows of its key.

    A key may hold every user, so it is not sorted as one group: values fall
    into cells of equal magnitude (a monotone function of the value), the
    different values of a cell are ranked with their counts, and the rows of lower cells are
    added from an aggregate that has a few thousand cells per key. Equal values
    cost an aggregate, and the ranks come back to the rows by an equi-join.
    """
    cell = F.floor(F.log10(F.greatest(m.dbl(value), F.lit(0.01))) * 500)
    distinct = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("_times")).withColumn("_cell", cell)
    counts = distinct.groupBy(key, "_cell").agg(F.sum("_times").alias("_n"))
    lower = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0))).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy(key))
    )
    inside = Window.partitionBy(key, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("_times").over(inside), F.lit(0)) + F.col("_before")
    share = F.when(F.col("_all") > 1, smaller / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    ranks = distinct.join(offsets.drop("_n"), [key, "_cell"]).select(key, value, share.alias("percent_rank"))
    return values.join(ranks, [key, value])


def peer_benchmark(labelled: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Each user's spending per category against all users, plus a row for the total."""
    fine = (
        in_period(active(labelled), start, end)
        .filter(is_debit())
        .groupBy("user_id", "category")
        .agg(F.sum("amount").alias("amount"))
    )
    total = fine.groupBy("user_id").agg(F.sum("amount").alias("amount")).withColumn("category", F.lit("All"))
    both = fine.unionByName(total)
    user_total = F.max(F.when(F.col("category") == "All", F.col("amount"))).over(Window.partitionBy("user_id"))
    shares = both.withColumn("user_percentage", m.ratio_pct(F.col("amount"), user_total))
    peers = both.groupBy("category").agg(
        (m.dbl(F.sum("amount")) / F.count(F.lit(1))).alias("average_amount"), F.sum("amount").alias("category_total")
    )
    grand = peers.filter("category = 'All'").first()
    everything = m.dbl(F.lit(grand["category_total"] if grand else 0))
    ranked = peer_percentile(shares)
    status = (
        F.when(m.dbl("amount") < F.col("average_amount") * 0.9, "below_average")
        .when(m.dbl("amount") > F.col("average_amount") * 1.1, "above_average")
        .otherwise("average")
    )
    return ranked.join(peers, "category").select(
        "user_id",
        "category",
        "amount",
        "user_percentage",
        "average_amount",
        (m.dbl("category_total") / everything * 100).alias("average_percentage"),
        F.floor(F.col("percent_rank") * 100).alias("percentile"),
        status.alias("status"),
    )


# Longest median gap in days, and payments per month.
FREQUENCIES = [(10, "weekly", 52 / 12), (20, "biweekly", 26 / 12), (45, "monthly", 1.0), (120, "quarterly", 1 / 3)]
YEARLY = ("yearly", 1 / 12)


def recurring_transactions(txns: DataFrame, start: dt.date, end: dt.date, min_count: int = 3) -> DataFrame:
    """Merchants paid at regular gaps: frequency, next expected day, monthly cost.

    Rows are reduced to one per (user, merchant, day), which bounds what the
    gap window sees by the number of days.
    """
    days = (
        in_period(active(txns), start, end)
        .filter(is_debit() & F.col("merchant_name").isNotNull())
        .groupBy("user_id", "merchant_name", F.to_date("transaction_date").alias("day"))
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("user_id", "merchant_name").orderBy("day")
    gaps = days.withColumn("gap", F.date_diff("day", F.lag("day").over(w)))
    merged = gaps.groupBy("user_id", "merchant_name").agg(
        F.sum("n").alias("transaction_count"),
        F.sum("amount").alias("total"),
        F.max("day").alias("last_occurrence"),
        F.percentile("gap", 0.5).alias("median_gap"),
        F.count(F.lit(1)).alias("distinct_days"),
    )
    gap = F.col("median_gap")
    frequency = F.lit(YEARLY[0])
    per_month = F.lit(YEARLY[1])
    for longest, name, factor in reversed(FREQUENCIES):
        frequency = F.when(gap <= longest, name).otherwise(frequency)
        per_month = F.when(gap <= longest, F.lit(float(factor))).otherwise(per_month)
    amount = m.dbl("total") / F.col("transaction_count")
    return merged.filter(F.col("distinct_days") >= min_count).select(
        "user_id",
        "merchant_name",
        "transaction_count",
        amount.alias("amount"),
        frequency.alias("frequency"),
        "last_occurrence",
        F.date_add("last_occurrence", F.floor(gap).cast("int")).alias("next_expected_date"),
        (amount * per_month).alias("monthly_amount"),
    )


def category_tree(categories: DataFrame) -> DataFrame:
    """Top-level categories with their children in display order, then by name."""
    kids = (
        categories.filter("parent_id IS NOT NULL")
        .groupBy("parent_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("display_order")).alias("o"), "name", "category_id", "slug"))).alias("children"))
    )
    top = categories.filter("parent_id IS NULL")
    kids = kids.withColumnRenamed("parent_id", "category_id")
    return top.drop("parent_id").join(kids, "category_id", "left").select(
        "category_id", "name", "is_income", "display_order", "children"
    )


def category_stats(txns: DataFrame, categories: DataFrame) -> DataFrame:
    """Count, total and share of every category over all of a user's rows."""
    sums = (
        active(txns)
        .filter("category_id IS NOT NULL")
        .groupBy("user_id", "category_id")
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"))
    )
    share = m.ratio_pct(F.col("total_amount"), F.sum("total_amount").over(Window.partitionBy("user_id")))
    return sums.withColumn("percentage_of_total", share).join(categories.select("category_id", "name"), "category_id")


def profile_counts(txns: DataFrame, budgets: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """How many transactions, budgets and own categories each user has."""
    kinds = [
        (active(txns).select("user_id"), "transactions_count"),
        (budgets.select("user_id"), "budgets_count"),
    ]
    if categories is not None:
        kinds.append((categories.select("user_id"), "categories_count"))
    parts = [df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)) for df, kind in kinds]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("user_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind) for _, kind in kinds]
    )
