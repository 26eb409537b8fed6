"""Rule-based insights, monthly summaries and benchmark comparison.

Measures are reduced to one row per user first; rules are then conditions on
that row, so adding a rule adds no scan and no shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions import money as m
from spendlake.functions.text import is_weekend, looks_like_subscription
from spendlake.operators.analytics import is_credit, is_debit, period_start
from spendlake.operators.filters import active, in_period
from spendlake.operators.ranking import half_split_trend, top_k

SEVERITIES = ["alert", "warning", "tip", "info"]


def severity_order(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def insight(
    rule: str,
    kind: str,
    severity: str,
    title: Column | str,
    message: Column | str | None = None,
    category: Column | None = None,
    amount: Column | None = None,
    percentage: Column | None = None,
    action: str | None = None,
) -> Column:
    def text(x: Column | str | None) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    def number(x: Column | None) -> Column:
        return (F.lit(None) if x is None else x).cast("double")

    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        text(title).alias("title"),
        text(message).alias("message"),
        text(category).alias("category"),
        number(amount).alias("amount"),
        number(percentage).alias("percentage"),
        F.lit(action).cast("string").alias("action"),
    )


def emit(df: DataFrame, rules: list[tuple[Column, Column]], keys: list[str] | None = None) -> DataFrame:
    """One output row per rule that holds."""
    items = F.array_compact(F.array(*[F.when(condition, item) for condition, item in rules]))
    return df.select(*(keys or ["user_id"]), F.inline(items))


def sort_insights(df: DataFrame) -> DataFrame:
    """Most severe first, inside each user."""
    return df.orderBy("user_id", severity_order(F.col("severity")), "rule", "category")


# --- insights of a user's current state ------------------------------------------


def insight_features(txns: DataFrame, categories: DataFrame, as_of: dt.date) -> DataFrame:
    """Summary, trend and breakdown measures of every user from one scan.

    180 days are summed to (user, month, category, direction); the rest works
    on that small table.
    """
    start, end = m.default_trend_period(as_of)
    month = m.month_start(as_of)
    base = (
        in_period(active(txns), start, end)
        .groupBy("user_id", period_start("monthly").alias("month"), "category_id", "transaction_type")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"), F.max("amount").alias("largest"))
    )
    parent = categories.select(F.col("category_id").alias("gid"), F.col("name").alias("group_name"))
    group = categories.select("category_id", F.coalesce("parent_id", "category_id").alias("gid")).join(parent, "gid")
    grouped = (
        base.join(group, "category_id", "left")
        .withColumn("known", F.col("category_id").isNull() | F.col("gid").isNotNull())
        .groupBy("user_id", "month", "gid", "group_name", "transaction_type")
        .agg(
            F.sum("amount").alias("amount"),
            F.sum("n").alias("n"),
            F.max("largest").alias("largest"),
            F.sum(F.when(F.col("known"), F.col("amount"))).alias("known_amount"),
            F.sum(F.when(F.col("category_id").isNull(), F.col("amount"))).alias("uncat_amount"),
            F.sum(F.when(F.col("category_id").isNull(), F.col("n"))).alias("uncat_n"),
        )
    )
    spent = is_debit()
    zero = F.lit(0).cast("decimal(15,2)")
    monthly = grouped.groupBy("user_id", "month").agg(
        m.sum_if(is_credit()).alias("income"),
        m.sum_if(spent).alias("expenses"),
        F.sum("n").alias("n"),
        F.max(F.when(spent, F.col("largest"))).alias("largest_expense"),
        F.coalesce(F.sum(F.when(spent, F.col("known_amount"))), zero).alias("breakdown_total"),
        F.coalesce(F.sum(F.when(spent, F.col("uncat_amount"))), zero).alias("uncat_amount"),
        F.coalesce(F.sum(F.when(spent, F.col("uncat_n"))), F.lit(0)).alias("uncat_n"),
        F.max(
            F.when(spent & F.col("gid").isNotNull(), F.struct("amount", (-F.col("gid")).alias("o"), "group_name"))
        ).alias("top"),
    )
    by_user = Window.partitionBy("user_id")
    ranked = monthly.withColumn("rn", F.row_number().over(by_user.orderBy("month"))).withColumn(
        "points", F.count(F.lit(1)).over(by_user)
    )
    early, now = F.col("rn") <= F.floor(F.col("points") / 2), F.col("month") == F.lit(month)
    non_zero = F.when(F.col("expenses") != 0, F.col("expenses").cast("decimal(18,2)"))
    f = ranked.groupBy("user_id").agg(
        F.max("points").alias("points"),
        m.sum_if(early, "expenses").alias("h1"),
        m.sum_if(~early, "expenses").alias("h2"),
        F.count(non_zero).alias("nz"),
        F.sum(non_zero).alias("nz_sum"),
        F.sum(non_zero * non_zero).alias("nz_squares"),
        m.sum_if(now, "income").alias("income"),
        m.sum_if(now, "expenses").alias("expenses"),
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("n"),
        F.max(F.when(now, F.col("largest_expense"))).alias("largest_expense"),
        F.max(F.when(now, F.col("breakdown_total"))).alias("breakdown_total"),
        F.max(F.when(now, F.col("uncat_amount"))).alias("uncat_amount"),
        F.coalesce(F.max(F.when(now, F.col("uncat_n"))), F.lit(0)).alias("uncat_n"),
        F.max(F.when(now, F.col("top"))).alias("top"),
    )
    net = F.col("income") - F.col("expenses")
    mean = m.dbl("nz_sum") / F.col("nz")
    variance = F.when(
        F.col("nz") > 1, (m.dbl("nz_squares") - m.dbl("nz_sum") * m.dbl("nz_sum") / F.col("nz")) / F.col("nz")
    ).otherwise(F.lit(0.0))
    trend = (
        F.when(F.col("points") < 2, "stable")
        .when(F.col("h2") * 10 > F.col("h1") * 11, "increasing")
        .when(F.col("h2") * 10 < F.col("h1") * 9, "decreasing")
        .otherwise("stable")
    )
    return f.select(
        "user_id",
        F.round(m.ratio_pct(net, F.col("income")), 2).alias("savings_rate"),
        trend.alias("trend"),
        F.col("top.group_name").alias("top_category"),
        F.col("top.amount").alias("top_amount"),
        F.round(m.ratio_pct(F.col("top.amount"), F.col("breakdown_total")), 2).alias("top_share"),
        "uncat_n",
        "uncat_amount",
        m.ratio_pct(F.col("uncat_amount"), F.col("breakdown_total")).alias("uncat_share"),
        "largest_expense",
        (m.dbl(F.col("income") + F.col("expenses")) / F.nullif(F.col("n"), F.lit(0))).alias("average_transaction"),
        mean.alias("mean_expenses"),
        variance.alias("variance"),
    )


def current_insights(features: DataFrame) -> DataFrame:
    c = F.col
    pct = lambda x: F.format_string("%.1f%%", x)
    rate = c("savings_rate")
    rules = [
        (rate < 20, insight("savings", "saving", "warning", "Low Savings Rate",
                            F.concat(F.lit("Your savings rate is "), pct(rate), F.lit(". Aim for at least 20% of income.")),
                            percentage=rate, action="Review expenses and find areas to cut back.")),
        (rate >= 30, insight("savings", "saving", "info", "Great Savings Rate!",
                             F.concat(F.lit("Your savings rate of "), pct(rate), F.lit(" is excellent.")), percentage=rate)),
        (c("trend") == "increasing", insight("trend", "spending", "warning", "Rising Spending Trend",
                                             "Spending has been increasing over the past months.",
                                             action="Review recent transactions for what drives the increase.")),
        (c("trend") == "decreasing", insight("trend", "spending", "info", "Declining Spending Trend",
                                             "Spending has been decreasing recently.")),
        (c("top_share") > 40, insight("top_category", "spending", "alert",
                                      F.concat(F.lit("High "), c("top_category"), F.lit(" Spending")),
                                      F.concat(c("top_category"), F.lit(" accounts for "), pct(c("top_share")), F.lit(" of spending.")),
                                      c("top_category"), c("top_amount"), c("top_share"))),
        (c("uncat_n") > 5, insight("uncategorized", "recommendation", "info", "Uncategorized Transactions",
                                   F.concat(c("uncat_n").cast("string"), F.lit(" transactions have no category ("), pct(c("uncat_share")), F.lit(" of spending).")),
                                   amount=c("uncat_amount"), percentage=c("uncat_share"),
                                   action="Categorize recent transactions.")),
        (m.dbl("largest_expense") > c("average_transaction") * 5,
         insight("large_expense", "anomaly", "info", "Large Expense Detected",
                 F.concat(F.lit("The largest expense ("), F.format_number("largest_expense", 2), F.lit(") is far above the average transaction.")),
                 amount=c("largest_expense"), action="Verify this transaction.")),
        (c("variance") > c("mean_expenses") * 0.5,
         insight("consistency", "spending", "info", "Inconsistent Spending Pattern",
                 "Spending varies significantly from month to month.", amount=c("mean_expenses"),
                 action="Consider a monthly spending limit.")),
    ]
    return emit(features, rules)


def insights_report(txns: DataFrame, categories: DataFrame, as_of: dt.date) -> DataFrame:
    """Insights of every user, with when they were made and when they expire."""
    return current_insights(insight_features(txns, categories, as_of)).select(
        "*", F.lit(as_of).alias("generated_at"), F.date_add(F.lit(as_of), 1).alias("next_update")
    )


# --- one calendar month ------------------------------------------------------------


def two_months(labelled: DataFrame, month: dt.date) -> DataFrame:
    """Category totals of a month and of the month before, from one scan."""
    rows = in_period(active(labelled), m.previous_month(month), m.month_end(month))
    now = F.col("transaction_date") >= F.lit(month)
    sums = rows.groupBy("user_id", "category", "transaction_type").agg(
        m.sum_if(now).alias("total"),
        m.sum_if(~now).alias("prev_total"),
        m.count_if(now).alias("n"),
        m.count_if(~now).alias("prev_n"),
    )
    return sums.withColumn("user_prev_n", F.sum("prev_n").over(Window.partitionBy("user_id")))


def month_change(total: Column, previous: Column) -> Column:
    """Against the previous month; 100 for a category that is new."""
    return (
        F.when(previous > 0, (m.dbl(total) - m.dbl(previous)) / m.dbl(previous) * 100)
        .when(total > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def category_changes(months: DataFrame) -> DataFrame:
    """Spending change of every category seen in either month.

    Users without any row in the previous month have nothing to compare with.
    """
    return months.filter(is_debit() & (F.col("user_prev_n") > 0)).select(
        "user_id", "category", "total", "prev_total", month_change(F.col("total"), F.col("prev_total")).alias("change")
    )


def month_categories(months: DataFrame) -> DataFrame:
    """Expense and income categories of the month with share, change and direction."""
    whole = F.sum("total").over(Window.partitionBy("user_id", "transaction_type"))
    # Income categories are not compared with the month before.
    prev = F.when(is_debit(), F.col("prev_total")).otherwise(F.lit(0).cast("decimal(15,2)"))
    rows = months.withColumn("change", month_change(F.col("total"), prev)).withColumn(
        "percentage_of_total", m.ratio_pct(F.col("total"), whole)
    )
    direction = F.when(F.col("change") > 10, "up").when(F.col("change") < -10, "down").otherwise("stable")
    return rows.filter(F.col("n") > 0).select(
        "user_id",
        "transaction_type",
        "category",
        F.col("total").alias("amount"),
        F.col("n").alias("transaction_count"),
        "percentage_of_total",
        (m.dbl("total") / F.col("n")).alias("average_transaction"),
        "change",
        direction.alias("trend"),
    )


def month_summary(months: DataFrame, month: dt.date) -> DataFrame:
    """Totals of the month per user and the category with the highest spending."""
    days = m.month_end(month).day
    s = months.filter(F.col("n") > 0).groupBy("user_id").agg(
        m.sum_if(is_credit(), "total").alias("total_income"),
        m.sum_if(is_debit(), "total").alias("total_expenses"),
        F.sum("n").alias("transaction_count"),
        F.max(F.when(is_debit(), F.col("total"))).alias("top_amount"),
        F.min(F.when(is_debit(), F.struct((-F.col("total")).alias("t"), "category"))).alias("_top"),
    )
    net = F.col("total_income") - F.col("total_expenses")
    return s.select(
        "user_id",
        F.lit(month).alias("month"),
        "total_income",
        "total_expenses",
        net.alias("net_savings"),
        m.ratio_pct(net, F.col("total_income")).alias("savings_rate"),
        (m.dbl("total_expenses") / days).alias("daily_average_spending"),
        "transaction_count",
        F.col("_top.category").alias("top_category"),
        "top_amount",
        m.ratio_pct(F.col("top_amount"), F.col("total_expenses")).alias("top_share"),
    )


def monthly_insights(months: DataFrame, month: dt.date) -> DataFrame:
    c = F.col
    rate = c("savings_rate")
    per_user = emit(
        month_summary(months, month),
        [
            (rate >= 30, insight("savings", "goal_progress", "info", "Great Savings Rate!",
                                 F.concat(F.lit("You saved "), F.format_string("%.1f%%", rate), F.lit(" of your income this month.")), percentage=rate)),
            (rate < 10, insight("savings", "saving_opportunity", "warning", "Low Savings This Month",
                                F.concat(F.lit("Your savings rate is only "), F.format_string("%.1f%%", rate)), percentage=rate,
                                action="Aim for at least 20% savings rate")),
            (c("top_category").isNotNull(), insight("top_category", "spending_pattern", "info", "Top Spending Category",
                                                    F.concat(c("top_category"), F.lit(" was your highest expense at ₹"), F.format_number("top_amount", 0)),
                                                    c("top_category"), c("top_amount"), c("top_share"))),
        ],
    )
    change = c("change")
    per_category = emit(
        category_changes(months),
        [
            (change > 50, insight("category_change", "category_alert", "warning", F.concat(c("category"), F.lit(" Spending Spike")),
                                  F.format_string("Your %s spending increased by %.0f%% from last month", c("category"), change),
                                  c("category"), percentage=change)),
            (change < -30, insight("category_change", "category_alert", "info", F.concat(c("category"), F.lit(" Spending Reduced")),
                                   F.format_string("Your %s spending decreased by %.0f%%", c("category"), F.abs(change)),
                                   c("category"), percentage=change)),
        ],
    )
    return per_user.unionByName(per_category)


def text_report(months: DataFrame, month: dt.date) -> DataFrame:
    """A short text per user: totals, five top categories, five insights."""
    from spendlake.functions.text import format_indian

    cats = top_k(
        month_categories(months).filter(is_debit()), ["user_id"], [F.col("amount").desc(), F.col("category")], 5
    )
    arrow = F.when(F.col("trend") == "up", "📈").when(F.col("trend") == "down", "📉").otherwise("➡️")
    line = F.concat(
        F.lit("  "), F.col("rank").cast("string"), F.lit(". "), "category", F.lit(": "), format_indian(F.col("amount")),
        F.format_string(" (%.1f%%) ", F.col("percentage_of_total")), arrow,
    )
    top = cats.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("top"))
    notes = top_k(
        monthly_insights(months, month), ["user_id"], [severity_order(F.col("severity")), F.col("rule"), F.col("category")], 5
    )
    mark = F.when(F.col("severity").isin("warning", "alert"), "  ⚠️ ").otherwise("  💡 ")
    texts = notes.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(mark, "message").alias("line")))).alias("notes")
    )
    head = F.concat_ws(
        "\n",
        F.lit(f"📊 Financial Summary - {month:%B %Y}"),
        F.lit("=" * 50),
        F.concat(F.lit("\n💰 Total Income: "), format_indian(F.col("total_income"))),
        F.concat(F.lit("💸 Total Expenses: "), format_indian(F.col("total_expenses"))),
        F.concat(F.lit("💵 Net Savings: "), format_indian(F.col("net_savings"))),
        F.format_string("📈 Savings Rate: %.1f%%", F.col("savings_rate")),
        F.lit("\n📋 Top Expense Categories:"),
    )
    return (
        month_summary(months, month)
        .join(top, "user_id", "left")
        .join(texts, "user_id", "left")
        .select(
            "user_id",
            F.concat_ws(
                "\n", head, F.col("top.line"), F.when(F.size("notes") > 0, F.lit("\n💡 Key Insights:")), F.col("notes.line")
            ).alias("report"),
        )
    )


# --- category analysis and benchmarks ----------------------------------------------


def benchmark_difference(amount: Column, benchmark: Column, months: int) -> Column:
    monthly = m.dbl(amount) / months
    return F.when(benchmark > 0, (monthly - benchmark) / benchmark * 100)


def category_analysis(
    labelled: DataFrame,
    start: dt.date,
    end: dt.date,
    months: int,
    category_benchmarks: DataFrame,
    subcategory_benchmarks: DataFrame,
) -> DataFrame:
    """Category rows and their sub-category rows (``level``), spending only.

    Categories are summed from the sub-category sums, so rows are scanned once
    for the amounts.
    """
    rows = in_period(active(labelled), start, end).filter(is_debit())
    fine = rows.groupBy("user_id", "category", "subcategory").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("transaction_count")
    )
    coarse = fine.groupBy("user_id", "category").agg(
        F.sum("amount").alias("amount"), F.sum("transaction_count").alias("transaction_count")
    )
    fine = (
        fine.withColumn("whole", F.sum("amount").over(Window.partitionBy("user_id", "category")))
        .join(half_split_trend(rows, ["user_id", "category", "subcategory"]), ["user_id", "category", "subcategory"], "left")
        .join(subcategory_benchmarks.select("subcategory", F.col("amount").alias("benchmark")), "subcategory", "left")
        .withColumn("level", F.lit("subcategory"))
    )
    coarse = (
        coarse.withColumn("whole", F.sum("amount").over(Window.partitionBy("user_id")))
        .join(half_split_trend(rows, ["user_id", "category"]), ["user_id", "category"], "left")
        .join(category_benchmarks.select("category", F.col("amount").alias("benchmark")), "category", "left")
        .withColumn("level", F.lit("category"))
        .withColumn("subcategory", F.lit(None).cast("string"))
    )
    return coarse.unionByName(fine).select(
        "user_id",
        "level",
        "category",
        "subcategory",
        "amount",
        "transaction_count",
        m.ratio_pct(F.col("amount"), F.col("whole")).alias("percentage_of_total"),
        (m.dbl("amount") / F.col("transaction_count")).alias("average_transaction"),
        F.coalesce("trend", F.lit("stable")).alias("trend"),
        benchmark_difference(F.col("amount"), F.col("benchmark"), months).alias("benchmark_difference"),
    )


def benchmark_comparison(category_totals: DataFrame, benchmarks: DataFrame, months: int = 1) -> DataFrame:
    """Monthly mean of each category against its benchmark.

    ``benchmarks`` holds one user type: (category, amount).
    """
    whole = float(benchmarks.agg(F.sum("amount")).first()[0] or 0)
    spending = m.dbl("total") / months
    diff = F.when(F.col("benchmark") > 0, (spending - F.col("benchmark")) / F.col("benchmark") * 100).otherwise(F.lit(0.0))
    status = (
        F.when(~(F.coalesce("benchmark", F.lit(0)) > 0), "no benchmark")
        .when(F.col("_diff") > 10, "above")
        .when(F.col("_diff") < -10, "below")
        .otherwise("on track")
    )
    user_total = m.dbl(F.sum("total").over(Window.partitionBy("user_id"))) / months
    overall = (user_total - whole) / whole * 100 if whole > 0 else F.lit(0.0)
    return (
        category_totals.join(benchmarks.select("category", F.col("amount").alias("benchmark")), "category", "left")
        .withColumn("_diff", diff)
        .select(
            "user_id",
            "category",
            m.round2(spending).alias("your_spending"),
            F.coalesce("benchmark", F.lit(0)).alias("benchmark"),
            m.round2(F.col("_diff")).alias("difference_percent"),
            status.alias("status"),
            user_total.alias("total_spending"),
            overall.alias("overall_difference"),
        )
    )


def benchmark_recommendations(comparison: DataFrame, limit: int = 5) -> DataFrame:
    """Overall remark first, then categories far off, highest overspending first."""
    c = F.col
    whole = lambda x: F.round(F.abs(x), 0).cast("bigint").cast("string")
    diff, overall = c("difference_percent"), c("overall_difference")
    each = comparison.filter(F.abs(diff) > 30).select(
        "user_id",
        F.lit(1).alias("part"),
        (-diff).alias("o"),
        "category",
        F.when(diff > 0, F.concat(F.lit("Consider reducing "), "category", F.lit(" spending - you're "), whole(diff), F.lit("% above benchmark")))
        .otherwise(F.concat(F.lit("Great job on "), "category", F.lit("! You're saving "), whole(diff), F.lit("% compared to average")))
        .alias("recommendation"),
    )
    total = (
        comparison.groupBy("user_id").agg(F.first("overall_difference").alias("overall_difference"))
        .filter((overall > 20) | (overall < -10))
        .select(
            "user_id",
            F.lit(0).alias("part"),
            F.lit(0.0).alias("o"),
            F.lit("").alias("category"),
            F.when(overall > 20, F.concat(F.lit("Overall spending is "), whole(overall), F.lit("% above benchmark. Focus on top overspending categories.")))
            .otherwise(F.concat(F.lit("Excellent! You're spending "), whole(overall), F.lit("% below average. Consider investing the savings.")))
            .alias("recommendation"),
        )
    )
    return top_k(total.unionByName(each), ["user_id"], [c("part"), c("o"), c("category")], limit, "position").select(
        "user_id", "position", "recommendation"
    )


# --- spending patterns over a period ------------------------------------------------


def day_patterns(labelled: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per-user measures behind the weekend, food, coffee and savings rules.

    Rows are summed per (user, day) first, which makes the distinct active
    days of a user a plain count.
    """
    sub = F.col("subcategory")
    coffee = sub.isin("Coffee/Tea", "Beverages") | F.coalesce(F.lower("merchant_name").contains("coffee"), F.lit(False))
    daily = (
        in_period(active(labelled), start, end)
        .filter(is_debit())
        .groupBy("user_id", F.to_date("transaction_date").alias("day"))
        .agg(
            F.sum("amount").alias("total"),
            m.sum_if(sub.isin("Food Delivery", "Fast Food")).alias("delivery"),
            m.sum_if(sub.isin("Groceries", "Ration", "Vegetables/Fruits")).alias("groceries"),
            m.sum_if(coffee).alias("coffee"),
            m.sum_if(F.col("category") == "Utilities").alias("utilities"),
        )
    )
    weekend = is_weekend(F.col("day"))
    sums = daily.groupBy("user_id").agg(
        m.sum_if(weekend, "total").alias("weekend_total"),
        m.count_if(weekend).alias("weekend_days"),
        m.sum_if(~weekend, "total").alias("weekday_total"),
        m.count_if(~weekend).alias("weekday_days"),
        *[F.sum(x).alias(x) for x in ("total", "delivery", "groceries", "coffee", "utilities")],
    )
    return sums.withColumn("weekend_daily", m.dbl("weekend_total") / F.greatest("weekend_days", F.lit(1))).withColumn(
        "weekday_daily", m.dbl("weekday_total") / F.greatest("weekday_days", F.lit(1))
    )


def subscription_merchants(labelled: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Spending per (user, merchant) that looks like a subscription."""
    test = looks_like_subscription(F.col("description"), F.col("merchant_name"), F.col("amount"), F.col("is_recurring"))
    return (
        in_period(active(labelled), start, end)
        .filter(is_debit() & test)
        .groupBy("user_id", "merchant_name")
        .agg(F.sum("amount").alias("total"))
    )


def subscriptions(merchants: DataFrame) -> DataFrame:
    return merchants.groupBy("user_id").agg(
        F.sum("total").alias("subscription_total"),
        F.count(F.nullif(F.col("merchant_name"), F.lit(""))).alias("subscription_count"),
    )


def recurring_patterns(labelled: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Same payee and whole amount on similar days of the month."""
    payee = F.coalesce(F.nullif(F.col("merchant_name"), F.lit("")), F.col("category"))
    day = F.dayofmonth("transaction_date")
    groups = (
        in_period(active(labelled), start, end)
        .filter(is_debit())
        .groupBy("user_id", payee.alias("payee"), F.floor("amount").alias("whole_amount"))
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
            F.sum(day).alias("days"),
            F.min(F.struct("transaction_date", "txn_id", "merchant_name", "category", "amount")).alias("first"),
        )
    )
    return groups.filter((F.col("occurrences") >= 2) & (F.col("last_day") - F.col("first_day") <= 5)).select(
        "user_id",
        "payee",
        F.col("first.merchant_name").alias("merchant_name"),
        F.col("first.category").alias("category"),
        F.col("first.amount").alias("amount"),
        F.floor(F.col("days") / F.col("occurrences")).alias("day"),
        "occurrences",
    )


def top_recurring(patterns: DataFrame, k: int = 3) -> DataFrame:
    return top_k(patterns, ["user_id"], [F.col("amount").desc(), F.col("payee")], k)


def spending_insights(
    labelled: DataFrame, benchmarks: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """All pattern rules of a period. ``benchmarks`` holds one user type."""
    c = F.col
    money = lambda x: F.concat(F.lit("₹"), F.format_number(x, 0))
    whole = float(benchmarks.agg(F.sum("amount")).first()[0] or 0)
    patterns = day_patterns(labelled, start, end)
    scalar = emit(
        patterns,
        [
            ((c("weekend_days") > 0) & (c("weekday_days") > 0) & (c("weekend_daily") > c("weekday_daily") * 1.5),
             insight("weekend", "time_pattern", "tip", "Weekend Spending Pattern",
                     F.concat(F.lit("Weekends average "), money(c("weekend_daily")), F.lit("/day, weekdays "), money(c("weekday_daily")), F.lit("/day")),
                     amount=c("weekend_daily") - c("weekday_daily"), action="Consider a weekend spending budget")),
            ((c("groceries") > 0) & (c("delivery") * 2 > c("groceries")),
             insight("food", "saving_opportunity", "tip", "Food Spending Pattern",
                     F.concat(F.lit("Food delivery is "), money(m.dbl("delivery")), F.lit(" against groceries of "), money(m.dbl("groceries"))),
                     F.lit("Food & Dining"), c("delivery"), action="Try meal prepping to reduce delivery orders")),
            ((c("coffee") > 0) & (c("utilities") > 0) & (c("coffee") * 10 > c("utilities") * 3),
             insight("coffee", "spending_pattern", "tip", "Coffee Spending",
                     F.concat(F.lit("Coffee costs "), money(m.dbl("coffee") * 12), F.lit(" a year at this rate")),
                     F.lit("Food & Dining"), c("coffee"), action="Try brewing at home some days")),
            (F.lit(whole > 0) & (m.dbl("total") > whole * 1.2),
             insight("benchmark", "saving_opportunity", "tip", "Potential Savings",
                     F.concat(F.lit("You could save "), money(m.dbl("total") - whole), F.lit(" a month")),
                     amount=m.dbl("total") - whole, action="Review categories above their benchmark")),
        ],
    )
    subs = emit(
        subscriptions(subscription_merchants(labelled, start, end)),
        [(F.lit(True), insight("subscriptions", "subscription_alert", "info", "Active Subscriptions",
                               F.concat(c("subscription_count").cast("string"), F.lit(" active subscriptions, "), money(m.dbl("subscription_total"))),
                               amount=c("subscription_total")))],
    )
    totals = in_period(active(labelled), start, end).filter(is_debit()).groupBy("user_id", "category").agg(F.sum("amount").alias("total"))
    high = emit(
        high_categories(totals, benchmarks),
        [(F.lit(True), insight("high_category", "category_alert", "warning", F.concat(F.lit("High "), c("category"), F.lit(" Spending")),
                               F.format_string("Your %s spending is %.0f%% above average", c("category"), c("percent_above")),
                               c("category"), c("total"), c("percent_above")))],
    )
    recurring = emit(
        top_recurring(recurring_patterns(labelled, start, end)),
        [(F.lit(True), insight("recurring", "recurring_detection", "info", F.concat(F.lit("Recurring: "), c("payee")),
                               F.concat(F.lit("Recurring expense of "), money(c("amount")), F.lit(" around day "), c("day").cast("string")),
                               c("category"), c("amount")))],
    )
    return scalar.unionByName(subs).unionByName(high).unionByName(recurring)


def high_categories(totals: DataFrame, benchmarks: DataFrame, factor: float = 1.5) -> DataFrame:
    b = benchmarks.select("category", F.col("amount").alias("benchmark"))
    diff = (m.dbl("total") - F.col("benchmark")) / F.col("benchmark") * 100
    return totals.join(b, "category").filter(m.dbl("total") > F.col("benchmark") * factor).withColumn("percent_above", diff)
