"""Forecast, anomaly and seasonality on monthly spending series.

Second moments come from exact decimal sums of x and x*x, which Spark combines
map-side, so a variance never needs the points of a user in one place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions import money as m


def square(c: str) -> Column:
    x = F.col(c).cast("decimal(18,2)")
    return x * x


def pop_std(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from count, sum and sum of squares."""
    t = m.dbl(total)
    return F.sqrt(F.greatest((m.dbl(squares) - t * t / n) / n, F.lit(0.0)))


def forecast(
    series: DataFrame,
    as_of: dt.date,
    months_ahead: int = 3,
    keys: tuple[str, ...] = ("user_id",),
    value: str = "expenses",
) -> DataFrame:
    """Mean of the last 3 points plus a linear step, with a widening 95% band."""
    by_key = Window.partitionBy(*keys)
    ranked = series.withColumn("_back", F.row_number().over(by_key.orderBy(F.col("period_date").desc())))
    stats = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("s"),
        F.sum(square(value)).alias("ss"),
        F.sum(F.when(F.col("_back") <= 3, F.col(value))).alias("recent"),
        F.min_by(value, "period_date").alias("first"),
        F.max_by(value, "period_date").alias("last"),
    )
    n = F.col("n")
    recent = m.dbl("recent") / F.least(n, F.lit(3))
    step = F.when(n >= 2, (m.dbl("last") - m.dbl("first")) / n).otherwise(F.lit(0.0))
    sigma = F.when(n >= 2, pop_std(n, F.col("s"), F.col("ss"))).otherwise(recent * 0.2)
    i = F.col("i")
    month_of = F.date_format(F.date_add(F.lit(as_of), (i * 30).cast("int")), "yyyy-MM")
    out = (
        stats.select(*keys, n, recent.alias("recent"), step.alias("step"), sigma.alias("sigma"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(months_ahead))))
        .withColumn("month", month_of)
        .withColumn("_p", F.greatest(F.lit(0.0), F.col("recent") + F.col("step") * i))
        .withColumn("_u", F.col("sigma") * (1 + (i - 1) * 0.1) * 1.96)
    )
    return out.select(
        *keys,
        i.alias("step_no"),
        "month",
        m.round2(F.col("_p")).alias("predicted"),
        m.round2(F.greatest(F.lit(0.0), F.col("_p") - F.col("_u"))).alias("confidence_lower"),
        m.round2(F.col("_p") + F.col("_u")).alias("confidence_upper"),
        F.col("n").alias("based_on_months"),
    )


def moving_average(series: DataFrame, value: str = "expenses", size: int = 3) -> DataFrame:
    """Mean of the current and up to ``size - 1`` earlier points."""
    w = Window.partitionBy("user_id").orderBy("period_date").rowsBetween(-(size - 1), 0)
    return series.withColumn("moving_average", m.dbl(F.sum(value).over(w)) / F.count(F.lit(1)).over(w))


def anomalies(series: DataFrame, value: str = "expenses", threshold: float = 2.0) -> DataFrame:
    """Each point against all earlier points of its user."""
    w = Window.partitionBy("user_id").orderBy("period_date").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(w)
    hist = (
        series.withColumn("n", n)
        .withColumn("s", F.sum(value).over(w))
        .withColumn("ss", F.sum(square(value)).over(w))
    )
    mean = m.dbl("s") / F.col("n")
    sigma = F.when(F.col("n") >= 2, pop_std(F.col("n"), F.col("s"), F.col("ss"))).otherwise(mean * 0.3)
    z = F.when(sigma > 0, F.abs(m.dbl(value) - mean) / sigma).otherwise(F.lit(0.0))
    is_anomaly = F.when(F.col("n") == 0, F.lit(False)).otherwise(z > threshold)
    return hist.select("user_id", "period_date", value, F.col("n").alias("history"), is_anomaly.alias("is_anomaly"))


def seasonal_factors(series: DataFrame, value: str = "expenses") -> DataFrame:
    """Mean of each calendar month over the mean of the month means; 1 if unseen."""
    monthly = (
        series.groupBy("user_id", F.month("period_date").alias("month"))
        .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
        .withColumn("month_mean", F.round(m.dbl("s") / F.col("n"), 6).cast("decimal(24,6)"))
    )
    per_user = monthly.groupBy("user_id").agg(
        F.sum("month_mean").alias("s"),
        F.count(F.lit(1)).alias("k"),
        F.map_from_entries(F.collect_list(F.struct("month", "month_mean"))).alias("by_month"),
    )
    overall = m.dbl("s") / F.col("k")
    seen = F.element_at("by_month", F.col("month"))
    factor = F.when(overall == 0, F.lit(1.0)).when(seen.isNull(), F.lit(1.0)).otherwise(m.dbl(seen) / overall)
    return per_user.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).select(
        "user_id", "month", F.round(factor, 6).alias("factor")
    )
