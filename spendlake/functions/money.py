"""Money arithmetic: sums stay decimal, ratios are double, rounding comes last."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F



def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def sum_if(condition: Column, amount: Column | str = "amount") -> Column:
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast("decimal(15,2)")))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def round2(c: Column) -> Column:
    """Round half up to 2 decimals in decimal arithmetic, free of binary ties."""
    return F.round(c.cast("decimal(38,6)"), 2).cast("double")


def ratio_pct(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0 when whole is not positive."""
    return F.when(whole > 0, dbl(part) / dbl(whole) * 100).otherwise(F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """Relative change in percent; a previous 0 gives 100 (growth) or 0."""
    return (
        F.when((previous == 0) & (current > 0), F.lit(100.0))
        .when(previous == 0, F.lit(0.0))
        .otherwise((dbl(current) - dbl(previous)) / dbl(previous) * 100)
    )


def period(start: dt.date, end: dt.date, column: str = "transaction_date") -> Column:
    """Both days inclusive, written on the raw column so that it reaches the scan."""
    c = F.col(column)
    return (c >= F.lit(start)) & (c < F.lit(end + dt.timedelta(days=1)))


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def previous_month(day: dt.date) -> dt.date:
    return (day.replace(day=1) - dt.timedelta(days=1)).replace(day=1)


def month_end(day: dt.date) -> dt.date:
    return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


def default_period(as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None):
    """Month to date unless given."""
    return start or month_start(as_of), end or as_of


def default_trend_period(as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None):
    """The 180 days up to ``end`` unless given."""
    end = end or as_of
    return start or end - dt.timedelta(days=180), end
