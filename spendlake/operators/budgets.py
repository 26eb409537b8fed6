"""Budgets against spending, and recommended budgets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions import money as m
from spendlake.operators.analytics import category_breakdown


def budget_status(txns: DataFrame, categories: DataFrame, budgets: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per budget: spent this month, utilisation, projection and alert."""
    spent = category_breakdown(txns, categories, as_of).select(
        "user_id", "category_id", F.col("amount").alias("spent")
    )
    names = categories.select("category_id", F.col("name").alias("category_name"))
    limit, zero = F.col("amount_limit"), F.lit(0).cast("decimal(15,2)")
    days_left = F.when(F.col("period") == "monthly", F.lit((m.month_end(as_of) - as_of).days)).otherwise(
        F.lit(7 - as_of.weekday())
    )
    rows = (
        budgets.join(spent, ["user_id", "category_id"], "left")
        .join(names, "category_id", "left")
        .withColumn("spent_amount", F.coalesce("spent", zero))
        .withColumn("_use", m.ratio_pct(F.col("spent_amount"), limit))
    )
    over = F.col("spent_amount") > limit
    # The threshold is a share (0..1), the utilisation a percentage.
    near = F.col("_use") >= F.col("alert_threshold") * 100
    alert = F.when(over, F.concat(F.lit("Over budget on "), "category_name")).when(
        near, F.concat("category_name", F.lit(" at "), F.round("_use", 0).cast("int").cast("string"), F.lit("% of budget"))
    )
    return rows.select(
        "budget_id",
        "user_id",
        "category_id",
        "category_name",
        limit.alias("budget_amount"),
        "spent_amount",
        (limit - F.col("spent_amount")).alias("remaining_amount"),
        F.round("_use", 2).alias("utilization_percentage"),
        over.alias("is_over_budget"),
        near.alias("is_alert_triggered"),
        (m.dbl("spent_amount") / as_of.day * 30).alias("projected_end_of_month"),
        days_left.alias("days_remaining"),
        alert.alias("alert"),
    )


def budget_overview(status: DataFrame) -> DataFrame:
    """Totals over a user's budgets and how many are on track, at risk or over."""
    s = status.groupBy("user_id").agg(
        F.sum("budget_amount").alias("total_budget"),
        F.sum("spent_amount").alias("total_spent"),
        m.count_if(~F.col("is_over_budget") & ~F.col("is_alert_triggered")).alias("budgets_on_track"),
        m.count_if(~F.col("is_over_budget") & F.col("is_alert_triggered")).alias("budgets_at_risk"),
        m.count_if(F.col("is_over_budget")).alias("budgets_over"),
        F.count("alert").alias("alert_count"),
    )
    return s.withColumn("total_remaining", F.col("total_budget") - F.col("total_spent")).withColumn(
        "overall_utilization", F.round(m.ratio_pct(F.col("total_spent"), F.col("total_budget")), 2)
    )


def budget_rule_errors(budgets: DataFrame) -> DataFrame:
    """Creation rules of a budget as a list of broken rules per row."""
    checks = F.array(
        F.when(~F.coalesce(F.col("amount_limit") > 0, F.lit(False)), F.lit("amount_limit must be positive")),
        F.when(F.col("end_date") <= F.col("start_date"), F.lit("end_date must be after start_date")),
        F.when(~F.col("alert_threshold").between(0.0, 1.0), F.lit("alert_threshold must be between 0 and 1")),
    )
    return budgets.withColumn("errors", F.array_compact(checks))


def rollover(status: DataFrame) -> DataFrame:
    """Amount a budget carries into the next period: what is left if its ``rollover_enabled``, else nothing."""
    none = F.lit(0).cast("decimal(15,2)")
    left = F.greatest(F.col("remaining_amount"), none)
    return status.withColumn("rollover_amount", F.when(F.col("rollover_enabled"), left).otherwise(none))


def recommended_budget(income: DataFrame, rules: DataFrame, rule: str = "detailed") -> DataFrame:
    """Income times the rule's share, per category. An unknown rule means 'detailed'."""
    known = rules.filter(F.col("rule") == rule)
    chosen = known if not known.isEmpty() else rules.filter(F.col("rule") == "detailed")
    shares = [(r["bucket"], float(r["pct"])) for r in chosen.orderBy("ord").collect()]
    # A rule has about a dozen buckets: explode them per row instead of a join.
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).alias("pct")) for b, p in shares])
    return (
        income.withColumn("_p", F.explode(pairs))
        .select(
            "user_id",
            F.col("_p.bucket").alias("bucket"),
            m.round2(F.col("net_income") * F.col("_p.pct").cast("decimal(5,4)")).alias("recommended"),
        )
    )
