"""Summaries, breakdowns, trends, merchants, budgets, forecast."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlake.operators import analytics as a
from spendlake.operators import budgets as b
from spendlake.operators import forecast as fc
from spendlake.operators import ranking
from spendlake.operators.filters import active, in_period
from spendlake.plans.registry import Inputs, query
from spendlake.sources import dimensions as dim

AS_OF = dt.date(2000, 6, 15)
YEAR = (dt.date(2000, 1, 1), dt.date(2000, 6, 15))

CHANGE = """CASE WHEN {p} = 0 AND {c} > 0 THEN 100.0 WHEN {p} = 0 THEN 0.0
 ELSE (CAST({c} AS DOUBLE) - CAST({p} AS DOUBLE)) / CAST({p} AS DOUBLE) * 100 END"""


def change(c: str, p: str) -> str:
    return "round(" + CHANGE.format(c=c, p=p) + ", 2)"


PERIODS = """
SELECT user_id,
 sum(CASE WHEN d >= DATE '{start}' AND transaction_type = 'CREDIT' THEN amount ELSE 0 END) AS inc,
 sum(CASE WHEN d >= DATE '{start}' AND transaction_type = 'DEBIT' THEN amount ELSE 0 END) AS exp,
 sum(CASE WHEN d < DATE '{start}' AND transaction_type = 'CREDIT' THEN amount ELSE 0 END) AS pinc,
 sum(CASE WHEN d < DATE '{start}' AND transaction_type = 'DEBIT' THEN amount ELSE 0 END) AS pexp,
 count(*) FILTER (WHERE d >= DATE '{start}') AS n,
 max(CASE WHEN d >= DATE '{start}' AND transaction_type = 'DEBIT' THEN amount END) AS maxe,
 max(CASE WHEN d >= DATE '{start}' AND transaction_type = 'CREDIT' THEN amount END) AS maxi
FROM (SELECT *, CAST(transaction_date AS DATE) AS d FROM transactions WHERE NOT is_deleted)
WHERE d BETWEEN DATE '{first}' AND DATE '{end}' GROUP BY user_id
"""


@query("A1_spending_summary", """user_id bigint, total_income double, total_expenses double, net_savings double,
 savings_rate double, transaction_count bigint, average_daily_spend double, largest_expense double, largest_income double""", f"""
SELECT user_id, inc AS total_income, exp AS total_expenses, inc - exp AS net_savings,
 round(CASE WHEN inc > 0 THEN CAST(inc - exp AS DOUBLE) / CAST(inc AS DOUBLE) * 100 ELSE 0 END, 2) AS savings_rate,
 n AS transaction_count, CAST(exp AS DOUBLE) / 15 AS average_daily_spend, maxe AS largest_expense, maxi AS largest_income
FROM ({PERIODS.format(start='2000-06-01', first='2000-06-01', end='2000-06-15')})
""")
def _(i: Inputs):
    return a.spending_summary(i.transactions, AS_OF, compare_previous=False)


@query("A2_summary_with_change", """user_id bigint, period_start string, total_income double, total_expenses double,
 income_change double, expense_change double, savings_change double""", f"""
SELECT user_id, '2000-06-01' AS period_start, inc AS total_income, exp AS total_expenses,
 {change('inc', 'pinc')} AS income_change, {change('exp', 'pexp')} AS expense_change,
 {change('(inc - exp)', '(pinc - pexp)')} AS savings_change
FROM ({PERIODS.format(start='2000-06-01', first='2000-05-17', end='2000-06-15')})
""")
def _(i: Inputs):
    return a.spending_summary(i.transactions, AS_OF)


BREAKDOWN = """
SELECT user_id, gid AS category_id, coalesce(gname, 'Uncategorized') AS category_name, amount,
 round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY user_id) AS DOUBLE) * 100, 2) AS percentage,
 n AS transaction_count, CAST(amount AS DOUBLE) / n AS average_transaction,
 sum(amount) OVER (PARTITION BY user_id) AS total_amount
FROM (SELECT t.user_id, g.category_id AS gid, g.name AS gname, sum(t.amount) AS amount, count(*) AS n
 FROM transactions t LEFT JOIN categories c ON t.category_id = c.category_id
 LEFT JOIN categories g ON g.category_id = coalesce(c.parent_id, c.category_id)
 WHERE NOT t.is_deleted AND t.transaction_type = 'DEBIT'
  AND CAST(t.transaction_date AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'
  AND (t.category_id IS NULL OR g.category_id IS NOT NULL)
 GROUP BY 1, 2, 3)
"""


@query("A3_category_breakdown", """user_id bigint, category_id bigint, category_name string, amount double, percentage double,
 transaction_count bigint, average_transaction double, total_amount double""",
       BREAKDOWN.format(start="2000-06-01", end="2000-06-15"))
def category_breakdown(i: Inputs):
    return a.category_breakdown(i.transactions, i.categories, AS_OF)


@query("J2_parent_rollup", "user_id bigint, category_id bigint, amount double, transaction_count bigint",
       f"SELECT user_id, category_id, amount, transaction_count FROM ({BREAKDOWN.format(start='1995-01-01', end='2001-12-31')}) WHERE category_id IS NOT NULL")
def _(i: Inputs):
    rows = a.category_breakdown(i.transactions, i.categories, AS_OF, dt.date(1995, 1, 1), dt.date(2001, 12, 31))
    return rows.filter("category_id IS NOT NULL")


@query("W7_share_of_total", "user_id bigint, category_id bigint, share double",
       f"SELECT user_id, category_id, CAST(amount AS DOUBLE) / CAST(total_amount AS DOUBLE) AS share FROM ({BREAKDOWN.format(start='2000-01-01', end='2000-06-15')})")
def _(i: Inputs):
    rows = a.category_breakdown(i.transactions, i.categories, AS_OF, *YEAR)
    return rows.withColumn("share", F.col("amount").cast("double") / F.col("total_amount").cast("double"))


FOCUS = """
SELECT *, CASE WHEN total > 0 THEN CAST(amount AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0 END AS percentage FROM (
 SELECT *, sum(amount) OVER (PARTITION BY user_id) AS total FROM (
 SELECT t.user_id, c.category_id, c.name AS category_name, sum(t.amount) AS amount, count(*) AS transaction_count
 FROM transactions t JOIN categories c ON {on}
 WHERE NOT t.is_deleted AND t.transaction_type = 'DEBIT'
  AND CAST(t.transaction_date AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2000-06-15'
  AND (c.slug IN ('food-dining', 'petrol', 'rent') OR lower(c.name) IN ('food', 'fuel', 'rent'))
 GROUP BY 1, 2, 3))
"""
FOCUS_COLUMNS = "user_id bigint, category_id bigint, category_name string, amount double, transaction_count bigint, percentage double"
FOCUS_NAMES = ["Food", "fuel", "Rent"]


@query("A4_focus_categories", FOCUS_COLUMNS, FOCUS.format(on="t.category_id = c.category_id"))
def _(i: Inputs):
    return a.focus_categories(i.transactions, i.categories, FOCUS_NAMES, AS_OF)


@query("A4_focus_rolled_up", FOCUS_COLUMNS, FOCUS.format(
    on="t.category_id = c.category_id OR t.category_id IN (SELECT k.category_id FROM categories k WHERE k.parent_id = c.category_id)"))
def _(i: Inputs):
    return a.focus_categories(i.transactions, i.categories, FOCUS_NAMES, AS_OF, roll_up=True)


@query("J3_focus_join", "category_id bigint, amount double, transaction_count bigint",
       f"SELECT category_id, sum(amount) AS amount, sum(transaction_count) AS transaction_count FROM ({FOCUS.format(on='t.category_id = c.category_id')}) GROUP BY 1")
def _(i: Inputs):
    rows = a.focus_categories(i.transactions, i.categories, FOCUS_NAMES, AS_OF)
    return rows.groupBy("category_id").agg(F.sum("amount").alias("amount"), F.sum("transaction_count").alias("transaction_count"))


@query("J4_focus_semi_join", "category_id bigint, name string, rows bigint", """
SELECT c.category_id, c.name, (SELECT count(*) FROM transactions t WHERE t.category_id = c.category_id) AS rows
FROM categories c WHERE c.slug IN ('groceries', 'clothesapparel', 'petrol') OR lower(c.name) IN ('grocery', 'clothes', 'gas')
""")
def _(i: Inputs):
    slugs, names = a.focus_keys(["grocery", "clothes", "gas"])
    chosen = i.categories.filter(F.col("slug").isin(slugs) | F.lower("name").isin(names))
    counts = i.transactions.groupBy("category_id").agg(F.count("*").alias("rows"))
    return chosen.join(counts, "category_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


SERIES = """
SELECT user_id, CAST(date_trunc('{unit}', transaction_date) AS DATE) AS period_date,
 sum(CASE WHEN transaction_type = 'CREDIT' THEN amount ELSE 0 END) AS income,
 sum(CASE WHEN transaction_type = 'DEBIT' THEN amount ELSE 0 END) AS expenses, count(*) AS transaction_count,
 sum(CASE WHEN transaction_type = 'CREDIT' THEN amount WHEN transaction_type = 'DEBIT' THEN -amount ELSE 0 END) AS net
FROM transactions WHERE NOT is_deleted AND CAST(transaction_date AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'
GROUP BY 1, 2
"""
SERIES_COLUMNS = "user_id bigint, period_date string, income double, expenses double, net double, transaction_count bigint"


def series_sql(unit: str, start: str = "1999-12-18", end: str = "2000-06-15") -> str:
    return SERIES.format(unit=unit, start=start, end=end)


@query("A5_trend_monthly", SERIES_COLUMNS, series_sql("month"))
def _(i: Inputs):
    return a.trend_series(i.transactions, AS_OF, "monthly")


@query("A6_trend_weekly", SERIES_COLUMNS, series_sql("week"))
def _(i: Inputs):
    return a.trend_series(i.transactions, AS_OF, "weekly")


@query("A6_trend_daily", SERIES_COLUMNS, series_sql("day"))
def _(i: Inputs):
    return a.trend_series(i.transactions, AS_OF, "daily")


TREND_SUMMARY = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period_date) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM ({series})),
 s AS (SELECT user_id, max(n) AS periods, sum(income) AS inc, sum(expenses) AS exp,
  sum(CASE WHEN rn <= n // 2 THEN expenses ELSE 0 END) AS h1, sum(CASE WHEN rn > n // 2 THEN expenses ELSE 0 END) AS h2,
  first(period_date ORDER BY expenses DESC, period_date) AS hd, max(expenses) AS ha,
  first(period_date ORDER BY expenses, period_date) AS ld, min(expenses) AS la FROM r GROUP BY user_id)
SELECT user_id, periods, CAST(inc AS DOUBLE) / periods AS average_income, CAST(exp AS DOUBLE) / periods AS average_expenses,
 CASE WHEN periods < 2 THEN 'stable' WHEN h2 * 10 > h1 * 11 THEN 'increasing' WHEN h2 * 10 < h1 * 9 THEN 'decreasing' ELSE 'stable' END AS overall_trend,
 hd AS highest_expense_date, ha AS highest_expense_amount, ld AS lowest_expense_date, la AS lowest_expense_amount
FROM s
"""
TREND_COLUMNS = """user_id bigint, periods bigint, average_income double, average_expenses double, overall_trend string,
 highest_expense_date string, highest_expense_amount double, lowest_expense_date string, lowest_expense_amount double"""


@query("A7_trend_summary", TREND_COLUMNS, TREND_SUMMARY.format(series=series_sql("month")))
def _(i: Inputs):
    return a.trend_summary(a.trend_series(i.transactions, AS_OF))


@query("W2_weekly_half_split", TREND_COLUMNS, TREND_SUMMARY.format(series=series_sql("week")))
def _(i: Inputs):
    return a.trend_summary(a.trend_series(i.transactions, AS_OF, "weekly"))


@query("A8_monthly_comparison", """user_id bigint, current_month string, previous_month string, current_income double, previous_income double,
 income_change double, current_expenses double, previous_expenses double, expenses_change double,
 current_savings double, previous_savings double, savings_change double""", f"""
SELECT user_id, '2000-06' AS current_month, '2000-05' AS previous_month, inc AS current_income, pinc AS previous_income,
 {change('inc', 'pinc')} AS income_change, exp AS current_expenses, pexp AS previous_expenses, {change('exp', 'pexp')} AS expenses_change,
 inc - exp AS current_savings, pinc - pexp AS previous_savings, {change('(inc - exp)', '(pinc - pexp)')} AS savings_change
FROM ({PERIODS.format(start='2000-06-01', first='2000-05-01', end='2000-06-15')})
""")
def _(i: Inputs):
    return a.monthly_comparison(i.transactions, AS_OF)


@query("A9_transaction_summary", """user_id bigint, total_income double, total_expense double, net_amount double,
 transaction_count bigint, avg_transaction_amount double, largest_expense double, largest_income double""", f"""
SELECT user_id, inc AS total_income, exp AS total_expense, inc - exp AS net_amount, n AS transaction_count,
 CAST(inc + exp AS DOUBLE) / n AS avg_transaction_amount, maxe AS largest_expense, maxi AS largest_income
FROM ({PERIODS.format(start='2000-01-01', first='2000-01-01', end='2000-06-15')})
""")
def _(i: Inputs):
    return a.transaction_summary(i.transactions, AS_OF, *YEAR)


MERCHANTS = """
SELECT user_id, merchant_name, sum(amount) AS total_amount, count(*) AS transaction_count,
 CAST(sum(amount) AS DOUBLE) / count(*) AS average_transaction, max(transaction_date) AS last_transaction_date,
 row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, merchant_name) AS rank
FROM transactions WHERE NOT is_deleted AND transaction_type = 'DEBIT' AND merchant_name IS NOT NULL
 AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-06-15' GROUP BY user_id, merchant_name
"""
MERCHANT_COLUMNS = """user_id bigint, merchant_name string, total_amount double, transaction_count bigint,
 average_transaction double, last_transaction_date string, rank bigint"""


@query("A10_top_merchants", MERCHANT_COLUMNS, f"SELECT * FROM ({MERCHANTS}) WHERE rank <= 10")
def _(i: Inputs):
    return a.top_merchants(i.transactions, AS_OF, 10, *YEAR)


@query("K3_top_k_by_sum", "user_id bigint, merchant_name string, rank bigint",
       f"SELECT user_id, merchant_name, rank FROM ({MERCHANTS}) WHERE rank <= 3")
def _(i: Inputs):
    return a.top_merchants(i.transactions, AS_OF, 3, *YEAR)


HALF = """
SELECT {keys}, CASE WHEN n < 4 THEN 'stable' WHEN h2 > h1 * 1.15 THEN 'up' WHEN h2 < h1 * 0.85 THEN 'down' ELSE 'stable' END AS trend
FROM (SELECT {keys}, n, CAST(sum(CASE WHEN rn <= n // 2 THEN amount ELSE 0 END) AS DOUBLE) / (n // 2) AS h1,
  CAST(sum(CASE WHEN rn > n // 2 THEN amount ELSE 0 END) AS DOUBLE) / (n - n // 2) AS h2
 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY transaction_date, txn_id) AS rn, count(*) OVER (PARTITION BY {keys}) AS n
  FROM {source}) GROUP BY {keys}, n) WHERE n > 1
"""
LABELLED_PERIOD = """(SELECT * FROM labelled WHERE NOT is_deleted AND transaction_type = 'DEBIT'
 AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-06-15')"""


@query("W1_half_split_trend", "user_id bigint, category string, trend string",
       HALF.format(keys="user_id, category", source=LABELLED_PERIOD))
def _(i: Inputs):
    rows = in_period(active(a.label_categories(i.transactions, i.categories)), *YEAR).filter(a.is_debit())
    return ranking.half_split_trend(rows, ["user_id", "category"])


@query("D3_merchant_analysis", """user_id bigint, merchant_name string, total_amount double, transaction_count bigint,
 total_merchant_count bigint, percentage_of_total double, trend string, rank bigint""", f"""
WITH m AS ({MERCHANTS}),
 t AS ({HALF.format(keys="user_id, merchant_name", source="(SELECT * FROM transactions WHERE NOT is_deleted AND transaction_type = 'DEBIT' AND merchant_name IS NOT NULL AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-06-15')")}),
 o AS (SELECT user_id, sum(total_amount) AS s, count(*) AS k FROM m GROUP BY user_id)
SELECT m.user_id, m.merchant_name, total_amount, transaction_count, k AS total_merchant_count,
 round(CAST(total_amount AS DOUBLE) / CAST(s AS DOUBLE) * 100, 2) AS percentage_of_total,
 CASE coalesce(t.trend, 'stable') WHEN 'up' THEN 'increasing' WHEN 'down' THEN 'decreasing' ELSE 'stable' END AS trend, rank
FROM m JOIN o ON m.user_id = o.user_id LEFT JOIN t ON t.user_id = m.user_id AND t.merchant_name = m.merchant_name
WHERE rank <= 10
""")
def _(i: Inputs):
    return a.merchant_analysis(i.transactions, *YEAR)


BUDGET = f"""
SELECT b.*, name AS category_name, coalesce(amount, 0) AS spent,
 CASE WHEN amount_limit > 0 THEN CAST(coalesce(amount, 0) AS DOUBLE) / CAST(amount_limit AS DOUBLE) * 100 ELSE 0 END AS use
FROM budgets b LEFT JOIN categories c ON b.category_id = c.category_id
LEFT JOIN (SELECT user_id AS u, category_id AS g, amount FROM ({BREAKDOWN.format(start='2000-06-01', end='2000-06-15')})) s
 ON s.u = b.user_id AND s.g = b.category_id
"""


@query("A11_budget_status", """budget_id bigint, user_id bigint, category_name string, budget_amount double, spent_amount double,
 remaining_amount double, utilization_percentage double, is_over_budget boolean, projected_end_of_month double,
 days_remaining bigint, alert string""", f"""
SELECT budget_id, user_id, category_name, amount_limit AS budget_amount, spent AS spent_amount, amount_limit - spent AS remaining_amount,
 round(use, 2) AS utilization_percentage, spent > amount_limit AS is_over_budget, CAST(spent AS DOUBLE) / 15 * 30 AS projected_end_of_month,
 CASE WHEN period = 'monthly' THEN 15 ELSE 4 END AS days_remaining,
 CASE WHEN spent > amount_limit THEN 'Over budget on ' || category_name
  WHEN use >= alert_threshold * 100 THEN category_name || ' at ' || CAST(CAST(round(use, 0) AS INT) AS VARCHAR) || '% of budget' END AS alert
FROM ({BUDGET})
""")
def _(i: Inputs):
    return b.budget_status(i.transactions, i.categories, i.budgets, AS_OF)


@query("J5_budget_left_join", "budget_id bigint, spent double", f"SELECT budget_id, spent FROM ({BUDGET})")
def _(i: Inputs):
    return b.budget_status(i.transactions, i.categories, i.budgets, AS_OF).withColumnRenamed("spent_amount", "spent")


@query("D7_budget_overview", """user_id bigint, total_budget double, total_spent double, total_remaining double, overall_utilization double,
 budgets_on_track bigint, budgets_at_risk bigint, budgets_over bigint, alert_count bigint""", f"""
SELECT user_id, sum(amount_limit) AS total_budget, sum(spent) AS total_spent, sum(amount_limit) - sum(spent) AS total_remaining,
 round(CAST(sum(spent) AS DOUBLE) / CAST(sum(amount_limit) AS DOUBLE) * 100, 2) AS overall_utilization,
 count(*) FILTER (WHERE spent <= amount_limit AND use < alert_threshold * 100) AS budgets_on_track,
 count(*) FILTER (WHERE spent <= amount_limit AND use >= alert_threshold * 100) AS budgets_at_risk,
 count(*) FILTER (WHERE spent > amount_limit) AS budgets_over,
 count(*) FILTER (WHERE spent > amount_limit OR use >= alert_threshold * 100) AS alert_count
FROM ({BUDGET}) GROUP BY user_id
""")
def _(i: Inputs):
    return b.budget_overview(b.budget_status(i.transactions, i.categories, i.budgets, AS_OF))


@query("D7_budget_rules", "budget_id bigint, errors string", """
SELECT budget_id, concat_ws('; ', CASE WHEN user_id % 7 = 0 THEN 'amount_limit must be positive' END,
 CASE WHEN user_id % 3 = 0 THEN 'end_date must be after start_date' END,
 CASE WHEN user_id % 5 = 0 THEN 'alert_threshold must be between 0 and 1' END) AS errors FROM budgets
""")
def _(i: Inputs):
    u = F.col("user_id")
    rows = i.budgets.select(
        "budget_id",
        F.when(u % 7 == 0, F.lit(0)).otherwise(F.col("amount_limit")).alias("amount_limit"),
        F.lit(dt.date(2000, 6, 1)).alias("start_date"),
        F.when(u % 3 == 0, F.lit(dt.date(2000, 6, 1))).otherwise(F.lit(dt.date(2000, 7, 1))).alias("end_date"),
        F.when(u % 5 == 0, F.lit(80.0)).otherwise(F.col("alert_threshold")).alias("alert_threshold"),
    )
    return b.budget_rule_errors(rows).withColumn("errors", F.concat_ws("; ", "errors"))


@query("D7_rollover", "budget_id bigint, rollover_amount double",
       f"SELECT budget_id, CASE WHEN budget_id % 2 = 0 THEN greatest(amount_limit - spent, 0) ELSE 0 END AS rollover_amount FROM ({BUDGET})")
def _(i: Inputs):
    status = b.budget_status(i.transactions, i.categories, i.budgets, AS_OF)
    return b.rollover(status.withColumn("rollover_enabled", F.col("budget_id") % 2 == 0))


@query("A29_recommended_budget", "user_id bigint, bucket string, recommended double", """
WITH inc AS (SELECT user_id, sum(amount) AS net_income FROM transactions
 WHERE NOT is_deleted AND transaction_type = 'CREDIT' AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2000-06-15' GROUP BY 1)
SELECT user_id, bucket, round(CAST(net_income * CAST(pct AS DECIMAL(5,4)) AS DECIMAL(38,6)), 2) AS recommended
FROM inc, (VALUES ('needs', CAST(0.5 AS DOUBLE)), ('wants', 0.3), ('savings', 0.2)) v(bucket, pct)
""")
def _(i: Inputs):
    income = a.spending_summary(i.transactions, AS_OF, compare_previous=False).filter("total_income > 0")
    return b.recommended_budget(income.withColumnRenamed("total_income", "net_income"), dim.budget_rules(i.spark), "50_30_20_rule")


YEAR_SERIES = series_sql("month", "1999-07-01", "2000-06-15")


def _year_series(i: Inputs):
    return a.trend_series(i.transactions, AS_OF, "monthly", dt.date(1999, 7, 1), AS_OF)


FORECAST = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY period_date DESC) AS back FROM ({series})),
 s AS (SELECT {keys}, count(*) AS n, sum({value}) AS s, sum(CAST({value} AS DECIMAL(18,2)) * CAST({value} AS DECIMAL(18,2))) AS ss,
  sum({value}) FILTER (WHERE back <= 3) AS rec, first({value} ORDER BY period_date) AS f, last({value} ORDER BY period_date) AS l FROM r GROUP BY {keys}),
 p AS (SELECT {keys}, n, CAST(rec AS DOUBLE) / least(n, 3) AS recent, CASE WHEN n >= 2 THEN (CAST(l AS DOUBLE) - CAST(f AS DOUBLE)) / n ELSE 0 END AS step,
  CASE WHEN n >= 2 THEN sqrt(greatest((CAST(ss AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n) / n, 0))
   ELSE CAST(rec AS DOUBLE) / least(n, 3) * CAST(0.2 AS DOUBLE) END AS sigma FROM s),
 f AS (SELECT *, greatest(CAST(0 AS DOUBLE), recent + step * i) AS pv, sigma * (1 + (i - 1) * CAST(0.1 AS DOUBLE)) * CAST(1.96 AS DOUBLE) AS u
  FROM p, (VALUES (1), (2), (3)) h(i))
SELECT {keys}, i AS step_no, strftime(DATE '2000-06-15' + CAST(30 * i AS INT), '%Y-%m') AS month, round(CAST(pv AS DECIMAL(38,6)), 2) AS predicted,
 round(CAST(greatest(0, pv - u) AS DECIMAL(38,6)), 2) AS confidence_lower, round(CAST(pv + u AS DECIMAL(38,6)), 2) AS confidence_upper, n AS based_on_months FROM f
"""
FORECAST_TAIL = "step_no bigint, month string, predicted double, confidence_lower double, confidence_upper double, based_on_months bigint"


@query("A30_forecast", "user_id bigint, " + FORECAST_TAIL, FORECAST.format(keys="user_id", value="expenses", series=YEAR_SERIES))
def _(i: Inputs):
    return fc.forecast(_year_series(i), AS_OF)


@query("D1_income_forecast", "user_id bigint, " + FORECAST_TAIL, FORECAST.format(keys="user_id", value="income", series=YEAR_SERIES))
def _(i: Inputs):
    return fc.forecast(_year_series(i), AS_OF, value="income")


@query("D1_category_forecast", "user_id bigint, category string, " + FORECAST_TAIL, FORECAST.format(
    keys="user_id, category", value="expenses",
    series="""SELECT user_id, category, CAST(date_trunc('month', transaction_date) AS DATE) AS period_date, sum(amount) AS expenses FROM labelled
 WHERE NOT is_deleted AND transaction_type = 'DEBIT' AND CAST(transaction_date AS DATE) BETWEEN DATE '1999-07-01' AND DATE '2000-06-15' GROUP BY 1, 2, 3"""))
def _(i: Inputs):
    rows = in_period(active(a.label_categories(i.transactions, i.categories)), dt.date(1999, 7, 1), AS_OF).filter(a.is_debit())
    series = rows.groupBy("user_id", "category", a.period_start("monthly").alias("period_date")).agg(F.sum("amount").alias("expenses"))
    return fc.forecast(series, AS_OF, keys=("user_id", "category"))


@query("W3_moving_average", "user_id bigint, period_date string, moving_average double", f"""
SELECT user_id, period_date, CAST(sum(expenses) OVER w AS DOUBLE) / count(*) OVER w AS moving_average FROM ({YEAR_SERIES})
WINDOW w AS (PARTITION BY user_id ORDER BY period_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def _(i: Inputs):
    return fc.moving_average(_year_series(i))


@query("A31_anomalies", "user_id bigint, period_date string, expenses double, history bigint, is_anomaly boolean", f"""
SELECT user_id, period_date, expenses, n AS history,
 CASE WHEN n = 0 THEN false WHEN sigma > 0 THEN abs(CAST(expenses AS DOUBLE) - mean) / sigma > 2 ELSE false END AS is_anomaly
FROM (SELECT *, CAST(s AS DOUBLE) / n AS mean,
  CASE WHEN n >= 2 THEN sqrt(greatest((CAST(ss AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n) / n, 0)) ELSE CAST(s AS DOUBLE) / n * CAST(0.3 AS DOUBLE) END AS sigma
 FROM (SELECT *, count(*) OVER w AS n, sum(expenses) OVER w AS s, sum(CAST(expenses AS DECIMAL(18,2)) * CAST(expenses AS DECIMAL(18,2))) OVER w AS ss
  FROM ({YEAR_SERIES}) WINDOW w AS (PARTITION BY user_id ORDER BY period_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
""")
def _(i: Inputs):
    return fc.anomalies(_year_series(i))


@query("A32_seasonal_factors", "user_id bigint, month bigint, factor double", f"""
WITH m AS (SELECT user_id, month(period_date) AS month, CAST(round(CAST(sum(expenses) AS DOUBLE) / count(*), 6) AS DECIMAL(24,6)) AS mm FROM ({series_sql('month', '1998-03-01', '2000-06-15')}) GROUP BY 1, 2),
 o AS (SELECT user_id, CAST(sum(mm) AS DOUBLE) / count(*) AS overall FROM m GROUP BY 1)
SELECT o.user_id, g.month, round(CASE WHEN overall = 0 OR mm IS NULL THEN 1 ELSE CAST(mm AS DOUBLE) / overall END, 6) AS factor
FROM o CROSS JOIN (SELECT unnest(range(1, 13)) AS month) g LEFT JOIN m ON m.user_id = o.user_id AND m.month = g.month
""")
def _(i: Inputs):
    return fc.seasonal_factors(a.trend_series(i.transactions, AS_OF, "monthly", dt.date(1998, 3, 1), AS_OF))
