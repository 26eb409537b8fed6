"""Spending analytics for every user at once (one row set per user_id)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions import money as m
from spendlake.functions.text import slug_of
from spendlake.operators.filters import active, in_period
from spendlake.operators.ranking import half_split_trend, top_k

def is_credit() -> Column:
    return F.col("transaction_type") == "CREDIT"


def is_debit() -> Column:
    return F.col("transaction_type") == "DEBIT"


# Short names people use for a category, and the slug they mean.
CATEGORY_ALIASES = {
    "clothes": "clothesapparel",
    "clothing": "clothesapparel",
    "apparel": "clothesapparel",
    "gas": "petrol",
    "fuel": "petrol",
    "grocery": "groceries",
    "groceriesration": "groceries",
    "food": "food-dining",
    "utilities": "utilities",
}


def spending_summary(
    txns: DataFrame,
    as_of: dt.date,
    start: dt.date | None = None,
    end: dt.date | None = None,
    compare_previous: bool = True,
) -> DataFrame:
    """Income, expenses, savings and their change against the preceding period.

    Both periods come from one scan of one contiguous date range.
    """
    start, end = m.default_period(as_of, start, end)
    days = max((end - start).days + 1, 1)
    first = start - dt.timedelta(days=days) if compare_previous else start
    rows = in_period(active(txns), first, end)
    now = F.col("transaction_date") >= F.lit(start)
    sums = rows.groupBy("user_id").agg(
        m.sum_if(now & is_credit()).alias("total_income"),
        m.sum_if(now & is_debit()).alias("total_expenses"),
        m.count_if(now).alias("transaction_count"),
        F.max(F.when(now & is_debit(), F.col("amount"))).alias("largest_expense"),
        F.max(F.when(now & is_credit(), F.col("amount"))).alias("largest_income"),
        m.sum_if(~now & is_credit()).alias("prev_income"),
        m.sum_if(~now & is_debit()).alias("prev_expenses"),
    )
    net = F.col("total_income") - F.col("total_expenses")
    prev_net = F.col("prev_income") - F.col("prev_expenses")
    out = sums.select(
        "user_id",
        F.lit(start).alias("period_start"),
        F.lit(end).alias("period_end"),
        "total_income",
        "total_expenses",
        net.alias("net_savings"),
        F.round(m.ratio_pct(net, F.col("total_income")), 2).alias("savings_rate"),
        "transaction_count",
        (m.dbl("total_expenses") / days).alias("average_daily_spend"),
        "largest_expense",
        "largest_income",
        *(
            [
                F.round(m.pct_change(F.col("total_income"), F.col("prev_income")), 2).alias("income_change"),
                F.round(m.pct_change(F.col("total_expenses"), F.col("prev_expenses")), 2).alias("expense_change"),
                F.round(m.pct_change(net, prev_net), 2).alias("savings_change"),
            ]
            if compare_previous
            else []
        ),
    )
    return out


def transaction_summary(
    txns: DataFrame, as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    start, end = m.default_period(as_of, start, end)
    sums = (
        in_period(active(txns), start, end)
        .groupBy("user_id")
        .agg(
            m.sum_if(is_credit()).alias("total_income"),
            m.sum_if(is_debit()).alias("total_expense"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.max(F.when(is_debit(), F.col("amount"))).alias("largest_expense"),
            F.max(F.when(is_credit(), F.col("amount"))).alias("largest_income"),
        )
    )
    both = F.col("total_income") + F.col("total_expense")
    return sums.select(
        "*",
        (F.col("total_income") - F.col("total_expense")).alias("net_amount"),
        (m.dbl(both) / F.col("transaction_count")).alias("avg_transaction_amount"),
    )


def category_breakdown(
    txns: DataFrame,
    categories: DataFrame,
    as_of: dt.date,
    start: dt.date | None = None,
    end: dt.date | None = None,
    transaction_type: str = "DEBIT",
) -> DataFrame:
    """Spending per top-level category, with uncategorised rows as one more row.

    Rows are summed per (user, category) first, so the category joins and the
    share window only see that small result.
    """
    start, end = m.default_period(as_of, start, end)
    fine = (
        in_period(active(txns), start, end)
        .filter(F.col("transaction_type") == transaction_type)
        .groupBy("user_id", "category_id")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    )
    group = categories.select("category_id", F.coalesce("parent_id", "category_id").alias("group_id"))
    name = categories.select(F.col("category_id").alias("group_id"), F.col("name").alias("category_name"))
    coarse = (
        fine.join(group, "category_id", "left")
        .filter(F.col("category_id").isNull() | F.col("group_id").isNotNull())
        .groupBy("user_id", "group_id")
        .agg(F.sum("amount").alias("amount"), F.sum("n").alias("transaction_count"))
        .join(name, "group_id", "left")
        .filter(F.col("group_id").isNull() | F.col("category_name").isNotNull())
    )
    total = F.sum("amount").over(Window.partitionBy("user_id"))
    return coarse.select(
        "user_id",
        F.col("group_id").alias("category_id"),
        F.coalesce("category_name", F.lit("Uncategorized")).alias("category_name"),
        "amount",
        F.round(m.ratio_pct(F.col("amount"), total), 2).alias("percentage"),
        "transaction_count",
        (m.dbl("amount") / F.col("transaction_count")).alias("average_transaction"),
        total.alias("total_amount"),
    )


def focus_keys(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Slugs (aliases resolved) and lower-case names of the wanted categories."""
    wanted = [n for n in names if n]
    slugs = [CATEGORY_ALIASES.get(s, s) for s in map(slug_of, wanted)]
    return slugs, [n.lower() for n in wanted]


def focus_categories(
    txns: DataFrame,
    categories: DataFrame,
    names: Sequence[str],
    as_of: dt.date,
    start: dt.date | None = None,
    end: dt.date | None = None,
    roll_up: bool = False,
) -> DataFrame:
    """Totals of the named categories and their share of the named total.

    A parent counts only rows attached to it directly unless ``roll_up``.
    """
    start, end = m.default_period(as_of, start, end)
    slugs, lowered = focus_keys(names)
    chosen = categories.filter(F.col("slug").isin(slugs) | F.lower("name").isin(lowered)).select(
        F.col("category_id").alias("focus_id"), F.col("name").alias("category_name")
    )
    member = categories.select(
        "category_id", (F.coalesce("parent_id", "category_id") if roll_up else F.col("category_id")).alias("focus_id")
    )
    if roll_up:
        member = member.unionByName(categories.select("category_id", F.col("category_id").alias("focus_id"))).distinct()
    spent = (
        in_period(active(txns), start, end)
        .filter(is_debit())
        .groupBy("user_id", "category_id")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
        .join(member.join(chosen, "focus_id"), "category_id")
        .groupBy("user_id", F.col("focus_id").alias("category_id"), "category_name")
        .agg(F.sum("amount").alias("amount"), F.sum("n").alias("transaction_count"))
    )
    total = F.sum("amount").over(Window.partitionBy("user_id"))
    return spent.withColumn("percentage", m.ratio_pct(F.col("amount"), total))


def period_start(granularity: str, ts: str = "transaction_date") -> Column:
    """First day of the month or (Monday) week, or the day itself."""
    day = F.to_date(ts)
    if granularity == "monthly":
        return F.trunc(day, "month")
    if granularity == "weekly":
        return F.trunc(day, "week")
    if granularity == "daily":
        return day
    raise ValueError(f"unknown granularity {granularity}")


def trend_series(
    txns: DataFrame,
    as_of: dt.date,
    granularity: str = "monthly",
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    start, end = m.default_trend_period(as_of, start, end)
    return (
        in_period(active(txns), start, end)
        .groupBy("user_id", period_start(granularity).alias("period_date"))
        .agg(
            m.sum_if(is_credit()).alias("income"),
            m.sum_if(is_debit()).alias("expenses"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .withColumn("net", F.col("income") - F.col("expenses"))
    )


def trend_summary(series: DataFrame) -> DataFrame:
    """Averages, half-against-half direction and extremes of a trend series."""
    by_user = Window.partitionBy("user_id")
    ranked = series.withColumn("rn", F.row_number().over(by_user.orderBy("period_date"))).withColumn(
        "n", F.count(F.lit(1)).over(by_user)
    )
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    first_date = -F.unix_date("period_date")
    sums = ranked.groupBy("user_id").agg(
        F.max("n").alias("periods"),
        F.sum("income").alias("income"),
        F.sum("expenses").alias("expenses"),
        m.sum_if(early, "expenses").alias("first_half"),
        m.sum_if(~early, "expenses").alias("second_half"),
        F.max(F.struct("expenses", first_date.alias("o"), "period_date")).alias("high"),
        F.min(F.struct("expenses", F.unix_date("period_date").alias("o"), "period_date")).alias("low"),
    )
    trend = (
        F.when(F.col("periods") < 2, "stable")
        .when(F.col("second_half") * 10 > F.col("first_half") * 11, "increasing")
        .when(F.col("second_half") * 10 < F.col("first_half") * 9, "decreasing")
        .otherwise("stable")
    )
    return sums.select(
        "user_id",
        "periods",
        (m.dbl("income") / F.col("periods")).alias("average_income"),
        (m.dbl("expenses") / F.col("periods")).alias("average_expenses"),
        trend.alias("overall_trend"),
        F.col("high.period_date").alias("highest_expense_date"),
        F.col("high.expenses").alias("highest_expense_amount"),
        F.col("low.period_date").alias("lowest_expense_date"),
        F.col("low.expenses").alias("lowest_expense_amount"),
    )


def monthly_comparison(txns: DataFrame, as_of: dt.date) -> DataFrame:
    """Month to date against the whole previous month, from one scan."""
    current, previous = m.month_start(as_of), m.previous_month(as_of)
    rows = in_period(active(txns), previous, as_of)
    now = F.col("transaction_date") >= F.lit(current)
    s = rows.groupBy("user_id").agg(
        m.sum_if(now & is_credit()).alias("current_income"),
        m.sum_if(~now & is_credit()).alias("previous_income"),
        m.sum_if(now & is_debit()).alias("current_expenses"),
        m.sum_if(~now & is_debit()).alias("previous_expenses"),
    )
    cur, prev = F.col("current_income") - F.col("current_expenses"), F.col("previous_income") - F.col("previous_expenses")

    def change(a: Column, b: Column) -> Column:
        return F.round(m.pct_change(a, b), 2)

    return s.select(
        "user_id",
        F.lit(current.strftime("%Y-%m")).alias("current_month"),
        F.lit(previous.strftime("%Y-%m")).alias("previous_month"),
        "current_income",
        "previous_income",
        change(F.col("current_income"), F.col("previous_income")).alias("income_change"),
        "current_expenses",
        "previous_expenses",
        change(F.col("current_expenses"), F.col("previous_expenses")).alias("expenses_change"),
        cur.alias("current_savings"),
        prev.alias("previous_savings"),
        change(cur, prev).alias("savings_change"),
    )


def merchant_totals(txns: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return (
        in_period(active(txns), start, end)
        .filter(is_debit() & F.col("merchant_name").isNotNull())
        .groupBy("user_id", "merchant_name")
        .agg(
            F.sum("amount").alias("total_amount"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.max("transaction_date").alias("last_transaction_date"),
        )
        .withColumn("average_transaction", m.dbl("total_amount") / F.col("transaction_count"))
    )


def top_merchants(
    txns: DataFrame,
    as_of: dt.date,
    limit: int = 10,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    start, end = m.default_period(as_of, start, end)
    order = [F.col("total_amount").desc(), F.col("merchant_name")]
    return top_k(merchant_totals(txns, start, end), ["user_id"], order, limit)


def merchant_analysis(txns: DataFrame, start: dt.date, end: dt.date, limit: int = 10) -> DataFrame:
    """Top merchants with share of all merchant spending, trend and merchant count."""
    totals = merchant_totals(txns, start, end)
    by_user = Window.partitionBy("user_id")
    overall = totals.groupBy("user_id").agg(
        F.sum("total_amount").alias("user_total"), F.count(F.lit(1)).alias("total_merchant_count")
    )
    top = top_k(totals, ["user_id"], [F.col("total_amount").desc(), F.col("merchant_name")], limit)
    rows = in_period(active(txns), start, end).filter(is_debit() & F.col("merchant_name").isNotNull())
    words = F.create_map(F.lit("up"), F.lit("increasing"), F.lit("down"), F.lit("decreasing"), F.lit("stable"), F.lit("stable"))
    trend = half_split_trend(rows, ["user_id", "merchant_name"]).withColumn("trend", words[F.col("trend")])
    return (
        top.join(overall, "user_id")
        .join(trend, ["user_id", "merchant_name"], "left")
        .withColumn("trend", F.coalesce("trend", F.lit("stable")))
        .withColumn("percentage_of_total", F.round(m.ratio_pct(F.col("total_amount"), F.col("user_total")), 2))
        .drop("user_total")
    )


def label_categories(txns: DataFrame, categories: DataFrame) -> DataFrame:
    """Add category (top level) and subcategory (the row's own) names."""
    parent = categories.select(F.col("category_id").alias("parent_id"), F.col("name").alias("_parent"))
    names = categories.join(parent, "parent_id", "left").select(
        "category_id",
        F.coalesce("_parent", "name").alias("_category"),
        F.col("name").alias("_subcategory"),
    )
    none = F.lit("Uncategorized")
    return (
        txns.join(names, "category_id", "left")
        .withColumn("category", F.coalesce("_category", none))
        .withColumn("subcategory", F.coalesce("_subcategory", none))
        .drop("_category", "_subcategory")
    )


def category_totals(labelled: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return (
        in_period(active(labelled), start, end)
        .filter(is_debit())
        .groupBy("user_id", "category")
        .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("transaction_count"))
    )
