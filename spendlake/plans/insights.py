"""Insights, monthly summaries, benchmarks and the declared operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions import money as m
from spendlake.operators import analytics as a
from spendlake.operators import declared as d
from spendlake.operators import insights as ins
from spendlake.operators.filters import active
from spendlake.plans.analytics import AS_OF, BREAKDOWN, HALF, LABELLED_PERIOD, PERIODS, TREND_SUMMARY, YEAR, series_sql
from spendlake.plans.registry import Inputs, query
from spendlake.sources import dimensions as dim

MAY = dt.date(2000, 5, 1)


def _labelled(i: Inputs):
    return a.label_categories(i.transactions, i.categories)


def _professional(i: Inputs):
    return dim.benchmarks(i.spark).filter("user_type = 'professional'").select("category", "amount")


# Same numbers as the benchmark dimension for 'professional'.
BENCH = """(VALUES ('Housing', 20000), ('Utilities', 4000), ('Transport', 6000), ('Food & Dining', 12000), ('Shopping', 6000),
 ('Healthcare', 3000), ('Entertainment', 4000), ('Financial', 15000), ('Education', 3000), ('Travel', 5000), ('Personal', 3000)) b(bcat, bench)"""
BENCH_TOTAL = 20000 + 4000 + 6000 + 12000 + 6000 + 3000 + 4000 + 15000 + 3000 + 5000 + 3000
SUB_BENCH = """(VALUES ('Petrol', 4000), ('Cab/Auto', 2000), ('Groceries', 5000), ('Restaurants', 4000), ('Food Delivery', 2500),
 ('Electricity', 2000), ('Mobile Recharge', 1000), ('Internet', 1500)) sb(bsub, bench)"""

# --- A24, A26 ----------------------------------------------------------------------

FEATURES = f"""
WITH s AS ({PERIODS.format(start='2000-06-01', first='2000-06-01', end='2000-06-15')}),
 ser AS ({series_sql('month')}),
 tr AS ({TREND_SUMMARY.format(series='SELECT * FROM ser')}),
 vr AS (SELECT user_id AS vu, count(*) AS k, sum(expenses) AS sx, sum(CAST(expenses AS DECIMAL(18,2)) * CAST(expenses AS DECIMAL(18,2))) AS sxx
  FROM ser WHERE expenses <> 0 GROUP BY 1),
 b AS ({BREAKDOWN.format(start='2000-06-01', end='2000-06-15')}),
 top AS (SELECT user_id AS bu, first(category_name ORDER BY amount DESC, category_id) FILTER (WHERE category_id IS NOT NULL) AS tc,
   first(amount ORDER BY amount DESC, category_id) FILTER (WHERE category_id IS NOT NULL) AS ta,
   max(total_amount) AS total, coalesce(sum(amount) FILTER (WHERE category_id IS NULL), 0) AS ua,
   coalesce(sum(transaction_count) FILTER (WHERE category_id IS NULL), 0) AS un FROM b GROUP BY 1)
SELECT tr.user_id, round(CASE WHEN inc > 0 THEN CAST(inc - exp AS DOUBLE) / CAST(inc AS DOUBLE) * 100 ELSE 0 END, 2) AS rate,
 overall_trend, tc, ta, round(CASE WHEN total > 0 THEN CAST(ta AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0 END, 2) AS share,
 coalesce(un, 0) AS un, ua, CASE WHEN total > 0 THEN CAST(ua AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0 END AS ushare,
 maxe, CAST(inc + exp AS DOUBLE) / nullif(n, 0) AS av, CAST(sx AS DOUBLE) / k AS mean,
 CASE WHEN k > 1 THEN (CAST(sxx AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sx AS DOUBLE) / k) / k ELSE 0 END AS variance
FROM tr LEFT JOIN s ON s.user_id = tr.user_id LEFT JOIN vr ON vu = tr.user_id LEFT JOIN top ON bu = tr.user_id
"""
INSIGHT_COLUMNS = "user_id bigint, rule string, type string, severity string, title string, category string, amount double, percentage double"
CURRENT = f"""
WITH f AS ({FEATURES})
SELECT user_id, 'savings' AS rule, 'saving' AS type, 'warning' AS severity, 'Low Savings Rate' AS title, NULL AS category, NULL AS amount, rate AS percentage FROM f WHERE rate < 20
UNION ALL SELECT user_id, 'savings', 'saving', 'info', 'Great Savings Rate!', NULL, NULL, rate FROM f WHERE rate >= 30
UNION ALL SELECT user_id, 'trend', 'spending', 'warning', 'Rising Spending Trend', NULL, NULL, NULL FROM f WHERE overall_trend = 'increasing'
UNION ALL SELECT user_id, 'trend', 'spending', 'info', 'Declining Spending Trend', NULL, NULL, NULL FROM f WHERE overall_trend = 'decreasing'
UNION ALL SELECT user_id, 'top_category', 'spending', 'alert', 'High ' || tc || ' Spending', tc, ta, share FROM f WHERE share > 40
UNION ALL SELECT user_id, 'uncategorized', 'recommendation', 'info', 'Uncategorized Transactions', NULL, ua, ushare FROM f WHERE un > 5
UNION ALL SELECT user_id, 'large_expense', 'anomaly', 'info', 'Large Expense Detected', NULL, maxe, NULL FROM f WHERE CAST(maxe AS DOUBLE) > av * 5
UNION ALL SELECT user_id, 'consistency', 'spending', 'info', 'Inconsistent Spending Pattern', NULL, mean, NULL FROM f WHERE variance > mean * 0.5
"""


@query("A24_current_insights", INSIGHT_COLUMNS, CURRENT)
def _(i: Inputs):
    return ins.current_insights(ins.insight_features(i.transactions, i.categories, AS_OF))


@query("A26_insights_report", "user_id bigint, rule string, severity string, generated_at string, next_update string",
       f"SELECT user_id, rule, severity, '2000-06-15' AS generated_at, '2000-06-16' AS next_update FROM ({CURRENT})")
def _(i: Inputs):
    return ins.sort_insights(ins.insights_report(i.transactions, i.categories, AS_OF))


# --- one month ---------------------------------------------------------------------

MONTHS = """
SELECT *, sum(prev_n) OVER (PARTITION BY user_id) AS user_prev_n FROM (
SELECT user_id, category, transaction_type, sum(CASE WHEN d >= DATE '2000-05-01' THEN amount ELSE 0 END) AS total,
 sum(CASE WHEN d < DATE '2000-05-01' THEN amount ELSE 0 END) AS prev_total,
 count(*) FILTER (WHERE d >= DATE '2000-05-01') AS n, count(*) FILTER (WHERE d < DATE '2000-05-01') AS prev_n
FROM (SELECT *, CAST(transaction_date AS DATE) AS d FROM labelled WHERE NOT is_deleted)
WHERE d BETWEEN DATE '2000-04-01' AND DATE '2000-05-31' GROUP BY 1, 2, 3)
"""
MONTH_CHANGE = """CASE WHEN {p} > 0 THEN (CAST(total AS DOUBLE) - CAST({p} AS DOUBLE)) / CAST({p} AS DOUBLE) * 100
 WHEN total > 0 THEN 100.0 ELSE 0.0 END"""
MONTH_SUMMARY = f"""
SELECT user_id, '2000-05-01' AS month, inc AS total_income, exp AS total_expenses, inc - exp AS net_savings,
 CASE WHEN inc > 0 THEN CAST(inc - exp AS DOUBLE) / CAST(inc AS DOUBLE) * 100 ELSE 0 END AS savings_rate,
 CAST(exp AS DOUBLE) / 31 AS daily_average_spending, n AS transaction_count, tc AS top_category, ta AS top_amount,
 CASE WHEN exp > 0 THEN CAST(ta AS DOUBLE) / CAST(exp AS DOUBLE) * 100 ELSE 0 END AS top_share
FROM (SELECT user_id, sum(CASE WHEN transaction_type = 'CREDIT' THEN total ELSE 0 END) AS inc,
 sum(CASE WHEN transaction_type = 'DEBIT' THEN total ELSE 0 END) AS exp, sum(n) AS n,
 first(category ORDER BY total DESC, category) FILTER (WHERE transaction_type = 'DEBIT') AS tc,
 max(total) FILTER (WHERE transaction_type = 'DEBIT') AS ta FROM ({MONTHS}) WHERE n > 0 GROUP BY 1)
"""
CHANGES = f"""SELECT user_id, category, total, prev_total, {MONTH_CHANGE.format(p='prev_total')} AS change FROM ({MONTHS})
WHERE transaction_type = 'DEBIT' AND user_prev_n > 0"""


def _months(i: Inputs):
    return ins.two_months(_labelled(i), MAY)


@query("A12_monthly_summary", """user_id bigint, month string, total_income double, total_expenses double, net_savings double, savings_rate double,
 daily_average_spending double, transaction_count bigint, top_category string, top_amount double""", MONTH_SUMMARY)
def _(i: Inputs):
    return ins.month_summary(_months(i), MAY)


@query("A13_category_change", """user_id bigint, transaction_type string, category string, amount double, transaction_count bigint,
 percentage_of_total double, average_transaction double, change double, trend string""", f"""
SELECT *, CASE WHEN change > 10 THEN 'up' WHEN change < -10 THEN 'down' ELSE 'stable' END AS trend FROM (
SELECT user_id, transaction_type, category, total AS amount, n AS transaction_count,
 CASE WHEN sum(total) OVER w > 0 THEN CAST(total AS DOUBLE) / CAST(sum(total) OVER w AS DOUBLE) * 100 ELSE 0 END AS percentage_of_total,
 CAST(total AS DOUBLE) / n AS average_transaction,
 CASE WHEN transaction_type = 'DEBIT' THEN {MONTH_CHANGE.format(p='prev_total')} WHEN total > 0 THEN 100 ELSE 0 END AS change
FROM ({MONTHS}) WHERE n > 0 WINDOW w AS (PARTITION BY user_id, transaction_type))
""")
def _(i: Inputs):
    return ins.month_categories(_months(i))


CHANGE_COLUMNS = "user_id bigint, category string, total double, prev_total double, change double"


@query("J7_period_comparison", CHANGE_COLUMNS, f"""
WITH cur AS (SELECT user_id, category, sum(amount) AS amt FROM labelled WHERE NOT is_deleted AND transaction_type = 'DEBIT'
  AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-05-01' AND DATE '2000-05-31' GROUP BY 1, 2),
 prev AS (SELECT user_id, category, sum(amount) AS amt FROM labelled WHERE NOT is_deleted AND transaction_type = 'DEBIT'
  AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-04-01' AND DATE '2000-04-30' GROUP BY 1, 2),
 had AS (SELECT DISTINCT user_id FROM transactions WHERE NOT is_deleted AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-04-01' AND DATE '2000-04-30')
SELECT user_id, category, total, prev_total, {MONTH_CHANGE.format(p='prev_total')} AS change FROM (
 SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.category, p.category) AS category, coalesce(c.amt, 0) AS total, coalesce(p.amt, 0) AS prev_total
 FROM cur c FULL JOIN prev p ON c.user_id = p.user_id AND c.category = p.category) WHERE user_id IN (SELECT user_id FROM had)
""")
def _(i: Inputs):
    return ins.category_changes(_months(i))


@query("U3_category_key_union", "user_id bigint, category string", f"SELECT user_id, category FROM ({CHANGES})")
def _(i: Inputs):
    return ins.category_changes(_months(i)).select("user_id", "category")


@query("A25_monthly_insights", INSIGHT_COLUMNS, f"""
WITH s AS ({MONTH_SUMMARY}), c AS ({CHANGES})
SELECT user_id, 'savings' AS rule, 'goal_progress' AS type, 'info' AS severity, 'Great Savings Rate!' AS title, NULL AS category, NULL AS amount, savings_rate AS percentage FROM s WHERE savings_rate >= 30
UNION ALL SELECT user_id, 'savings', 'saving_opportunity', 'warning', 'Low Savings This Month', NULL, NULL, savings_rate FROM s WHERE savings_rate < 10
UNION ALL SELECT user_id, 'top_category', 'spending_pattern', 'info', 'Top Spending Category', top_category, top_amount, top_share FROM s WHERE top_category IS NOT NULL
UNION ALL SELECT user_id, 'category_change', 'category_alert', 'warning', category || ' Spending Spike', category, NULL, change FROM c WHERE change > 50
UNION ALL SELECT user_id, 'category_change', 'category_alert', 'info', category || ' Spending Reduced', category, NULL, change FROM c WHERE change < -30
""")
def _(i: Inputs):
    return ins.monthly_insights(_months(i), MAY)


@query("C21_text_report", "user_id bigint, report string")
def _(i: Inputs):
    return ins.text_report(_months(i), MAY)


# --- category analysis, benchmarks ---------------------------------------------------

FINE = f"SELECT user_id, category, subcategory, sum(amount) AS amount, count(*) AS n FROM {LABELLED_PERIOD} GROUP BY 1, 2, 3"
ANALYSIS = f"""
WITH f AS ({FINE}), c AS (SELECT user_id, category, sum(amount) AS amount, sum(n) AS n FROM f GROUP BY 1, 2),
 t1 AS ({HALF.format(keys='user_id, category', source=LABELLED_PERIOD)}),
 t2 AS ({HALF.format(keys='user_id, category, subcategory', source=LABELLED_PERIOD)})
SELECT c.user_id, 'category' AS level, c.category, NULL AS subcategory, amount, n AS transaction_count,
 CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY c.user_id) AS DOUBLE) * 100 AS percentage_of_total,
 CAST(amount AS DOUBLE) / n AS average_transaction, coalesce(trend, 'stable') AS trend,
 (CAST(amount AS DOUBLE) / 6 - bench) / bench * 100 AS benchmark_difference
FROM c LEFT JOIN t1 ON t1.user_id = c.user_id AND t1.category = c.category LEFT JOIN {BENCH} ON bcat = c.category
UNION ALL
SELECT f.user_id, 'subcategory', f.category, f.subcategory, amount, n,
 CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY f.user_id, f.category) AS DOUBLE) * 100,
 CAST(amount AS DOUBLE) / n, coalesce(trend, 'stable'), (CAST(amount AS DOUBLE) / 6 - bench) / bench * 100
FROM f LEFT JOIN t2 ON t2.user_id = f.user_id AND t2.category = f.category AND t2.subcategory = f.subcategory LEFT JOIN {SUB_BENCH} ON bsub = f.subcategory
"""


@query("A14_category_analysis", """user_id bigint, level string, category string, subcategory string, amount double, transaction_count bigint,
 percentage_of_total double, average_transaction double, trend string, benchmark_difference double""", ANALYSIS)
def _(i: Inputs):
    subs = dim.subcategory_benchmarks(i.spark).filter("user_type = 'professional'")
    return ins.category_analysis(_labelled(i), *YEAR, 6, _professional(i), subs)


@query("K4_ordered_by_amount", "user_id bigint, level string, category string, subcategory string, amount double",
       f"SELECT user_id, level, category, subcategory, amount FROM ({ANALYSIS})")
def _(i: Inputs):
    subs = dim.subcategory_benchmarks(i.spark).filter("user_type = 'professional'")
    rows = ins.category_analysis(_labelled(i), *YEAR, 6, _professional(i), subs)
    return rows.orderBy("user_id", "level", F.col("amount").desc(), "category", "subcategory")


TOTALS = f"SELECT user_id, category, sum(amount) AS total, count(*) AS transaction_count FROM {LABELLED_PERIOD} GROUP BY 1, 2"


@query("A15_category_totals", "user_id bigint, category string, total double, transaction_count bigint", TOTALS)
def _(i: Inputs):
    return a.category_totals(_labelled(i), *YEAR)


@query("J6_benchmark_left_join", "user_id bigint, category string, total double, benchmark bigint", f"""
SELECT user_id, category, total, amount AS benchmark FROM ({TOTALS}) t LEFT JOIN benchmarks b ON b.category = t.category AND b.user_type = 'professional'
""".replace("SELECT user_id, category, total, amount", "SELECT t.user_id, t.category, t.total, b.amount"))
def _(i: Inputs):
    b = i.benchmarks.filter("user_type = 'professional'").select("category", F.col("amount").alias("benchmark"))
    return a.category_totals(_labelled(i), *YEAR).join(b, "category", "left")


COMPARISON = f"""
SELECT user_id, category, round(CAST(your AS DECIMAL(38,6)), 2) AS your_spending, coalesce(bench, 0) AS benchmark,
 round(CAST(CASE WHEN bench > 0 THEN (your - bench) / bench * 100 ELSE 0 END AS DECIMAL(38,6)), 2) AS difference_percent,
 CASE WHEN bench IS NULL THEN 'no benchmark' WHEN (your - bench) / bench * 100 > 10 THEN 'above' WHEN (your - bench) / bench * 100 < -10 THEN 'below' ELSE 'on track' END AS status,
 ut AS total_spending, (ut - {BENCH_TOTAL}) / {BENCH_TOTAL} * 100 AS overall_difference
FROM (SELECT *, CAST(total AS DOUBLE) / 6 AS your, CAST(sum(total) OVER (PARTITION BY user_id) AS DOUBLE) / 6 AS ut FROM ({TOTALS})) LEFT JOIN {BENCH} ON bcat = category
"""


@query("A23_benchmark_comparison", """user_id bigint, category string, your_spending double, benchmark bigint, difference_percent double,
 status string, total_spending double, overall_difference double""", COMPARISON)
def _(i: Inputs):
    return ins.benchmark_comparison(a.category_totals(_labelled(i), *YEAR), _professional(i), 6)


@query("K6_by_difference", "user_id bigint, category string, difference_percent double",
       f"SELECT user_id, category, difference_percent FROM ({COMPARISON})")
def _(i: Inputs):
    rows = ins.benchmark_comparison(a.category_totals(_labelled(i), *YEAR), _professional(i), 6)
    return rows.orderBy("user_id", F.col("difference_percent").desc(), "category")


@query("A23_recommendations", "user_id bigint, position bigint, recommendation string", f"""
WITH c AS ({COMPARISON}),
 r AS (SELECT user_id, 1 AS part, -CAST(difference_percent AS DOUBLE) AS o, category, CASE WHEN difference_percent > 30
   THEN 'Consider reducing ' || category || ' spending - you''re ' || CAST(CAST(round(abs(CAST(difference_percent AS DOUBLE)), 0) AS BIGINT) AS VARCHAR) || '% above benchmark'
   ELSE 'Great job on ' || category || '! You''re saving ' || CAST(CAST(round(abs(CAST(difference_percent AS DOUBLE)), 0) AS BIGINT) AS VARCHAR) || '% compared to average' END AS recommendation
  FROM c WHERE abs(difference_percent) > 30
  UNION ALL SELECT DISTINCT user_id, 0, 0, '', CASE WHEN overall_difference > 20
   THEN 'Overall spending is ' || CAST(CAST(round(abs(overall_difference), 0) AS BIGINT) AS VARCHAR) || '% above benchmark. Focus on top overspending categories.'
   ELSE 'Excellent! You''re spending ' || CAST(CAST(round(abs(overall_difference), 0) AS BIGINT) AS VARCHAR) || '% below average. Consider investing the savings.' END
  FROM c WHERE overall_difference > 20 OR overall_difference < -10)
SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY part, o, category) AS position, recommendation FROM r) WHERE position <= 5
""")
def _(i: Inputs):
    return ins.benchmark_recommendations(ins.benchmark_comparison(a.category_totals(_labelled(i), *YEAR), _professional(i), 6))


# --- patterns over a period ----------------------------------------------------------

DAYS = f"""
SELECT user_id, CAST(transaction_date AS DATE) AS day, sum(amount) AS total,
 sum(CASE WHEN subcategory IN ('Food Delivery', 'Fast Food') THEN amount ELSE 0 END) AS delivery,
 sum(CASE WHEN subcategory IN ('Groceries', 'Ration', 'Vegetables/Fruits') THEN amount ELSE 0 END) AS groceries,
 sum(CASE WHEN subcategory IN ('Coffee/Tea', 'Beverages') OR lower(merchant_name) LIKE '%coffee%' THEN amount ELSE 0 END) AS coffee,
 sum(CASE WHEN category = 'Utilities' THEN amount ELSE 0 END) AS utilities
FROM {LABELLED_PERIOD} GROUP BY 1, 2
"""
WEEKENDS = f"""
SELECT user_id, CAST(coalesce(sum(total) FILTER (WHERE isodow(day) >= 6), 0) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE isodow(day) >= 6)) AS weekend_daily,
 CAST(coalesce(sum(total) FILTER (WHERE isodow(day) < 6), 0) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE isodow(day) < 6)) AS weekday_daily,
 count(*) FILTER (WHERE isodow(day) >= 6) AS weekend_days, count(*) FILTER (WHERE isodow(day) < 6) AS weekday_days,
 sum(total) AS total, sum(delivery) AS delivery, sum(groceries) AS groceries, sum(coffee) AS coffee, sum(utilities) AS utilities
FROM ({DAYS}) GROUP BY user_id
"""


def _patterns(i: Inputs):
    return ins.day_patterns(_labelled(i), *YEAR)


@query("A16_weekend_pattern", "user_id bigint, weekend_daily double, weekday_daily double, is_pattern boolean", f"""
SELECT user_id, weekend_daily, weekday_daily, weekend_days > 0 AND weekday_days > 0 AND weekend_daily > weekday_daily * 1.5 AS is_pattern FROM ({WEEKENDS})
""")
def _(i: Inputs):
    c = F.col
    test = (c("weekend_days") > 0) & (c("weekday_days") > 0) & (c("weekend_daily") > c("weekday_daily") * 1.5)
    return _patterns(i).withColumn("is_pattern", test)


SUBS = f"""
SELECT user_id, sum(amount) AS subscription_total, count(DISTINCT merchant_name) AS subscription_count FROM {LABELLED_PERIOD}
WHERE regexp_matches(lower(description) || ' ' || lower(coalesce(merchant_name, '')), '{"|".join(v.SUBSCRIPTION_WORDS)}')
 OR amount IN ({", ".join(map(str, v.SUBSCRIPTION_PRICES))}) OR is_recurring GROUP BY 1
"""


@query("A17_subscriptions", "user_id bigint, subscription_total double, subscription_count bigint", SUBS)
def _(i: Inputs):
    return ins.subscriptions(ins.subscription_merchants(_labelled(i), *YEAR))


@query("A18_high_categories", "user_id bigint, category string, total double, percent_above double", f"""
SELECT user_id, category, total, (CAST(total AS DOUBLE) - bench) / bench * 100 AS percent_above FROM ({TOTALS}) JOIN {BENCH} ON bcat = category
WHERE CAST(total AS DOUBLE) > bench * 1.5
""")
def _(i: Inputs):
    return ins.high_categories(a.category_totals(_labelled(i), *YEAR), _professional(i))


@query("A19_food_ratio", "user_id bigint, delivery double, groceries double, is_high boolean", f"""
SELECT user_id, delivery, groceries, groceries > 0 AND delivery * 2 > groceries AS is_high FROM ({WEEKENDS})
""")
def _(i: Inputs):
    return _patterns(i).withColumn("is_high", (F.col("groceries") > 0) & (F.col("delivery") * 2 > F.col("groceries")))


REPEATS = """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, payee) AS rank FROM (
SELECT user_id, coalesce(nullif(merchant_name, ''), category) AS payee, first(category ORDER BY transaction_date, txn_id) AS category,
 first(amount ORDER BY transaction_date, txn_id) AS amount, sum(day(transaction_date)) // count(*) AS day, count(*) AS occurrences
FROM (SELECT r.*, coalesce(p.name, c.name, 'Uncategorized') AS category FROM repeat_transactions r
 LEFT JOIN categories c ON r.category_id = c.category_id LEFT JOIN categories p ON c.parent_id = p.category_id
 WHERE NOT is_deleted AND transaction_type = 'DEBIT' AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-06-15')
GROUP BY user_id, coalesce(nullif(merchant_name, ''), category), floor(amount)
HAVING count(*) >= 2 AND max(day(transaction_date)) - min(day(transaction_date)) <= 5)
"""


def _recurring(i: Inputs):
    rows = a.label_categories(i.repeat_transactions, i.categories)
    return ins.recurring_patterns(rows, *YEAR)


@query("A20_recurring_patterns", "user_id bigint, payee string, category string, amount double, day bigint, occurrences bigint",
       f"SELECT user_id, payee, category, amount, day, occurrences FROM ({REPEATS})")
def _(i: Inputs):
    return _recurring(i)


@query("A20_top_recurring", "user_id bigint, payee string, amount double, rank bigint",
       f"SELECT user_id, payee, amount, rank FROM ({REPEATS}) WHERE rank <= 3")
def _(i: Inputs):
    return ins.top_recurring(_recurring(i))


@query("A21_coffee_ratio", "user_id bigint, coffee double, yearly double, is_high boolean", f"""
SELECT user_id, coffee, CAST(coffee AS DOUBLE) * 12 AS yearly, coffee > 0 AND utilities > 0 AND coffee * 10 > utilities * 3 AS is_high FROM ({WEEKENDS})
""")
def _(i: Inputs):
    c = F.col
    return _patterns(i).select(
        "user_id", "coffee", (m.dbl("coffee") * 12).alias("yearly"),
        ((c("coffee") > 0) & (c("utilities") > 0) & (c("coffee") * 10 > c("utilities") * 3)).alias("is_high"),
    )


@query("A22_potential_savings", "user_id bigint, potential_savings double",
       f"SELECT user_id, CAST(total AS DOUBLE) - {BENCH_TOTAL} AS potential_savings FROM ({WEEKENDS}) WHERE CAST(total AS DOUBLE) > {BENCH_TOTAL} * 1.2")
def _(i: Inputs):
    rows = ins.spending_insights(_labelled(i), _professional(i), *YEAR).filter("rule = 'benchmark'")
    return rows.select("user_id", F.col("amount").alias("potential_savings"))


@query("K5_severity_order", INSIGHT_COLUMNS, f"""
WITH w AS ({WEEKENDS}), s AS ({SUBS})
SELECT user_id, 'weekend' AS rule, 'time_pattern' AS type, 'tip' AS severity, 'Weekend Spending Pattern' AS title, NULL AS category, weekend_daily - weekday_daily AS amount, NULL AS percentage
 FROM w WHERE weekend_days > 0 AND weekday_days > 0 AND weekend_daily > weekday_daily * 1.5
UNION ALL SELECT user_id, 'food', 'saving_opportunity', 'tip', 'Food Spending Pattern', 'Food & Dining', CAST(delivery AS DOUBLE), NULL FROM w WHERE groceries > 0 AND delivery * 2 > groceries
UNION ALL SELECT user_id, 'coffee', 'spending_pattern', 'tip', 'Coffee Spending', 'Food & Dining', CAST(coffee AS DOUBLE), NULL FROM w WHERE coffee > 0 AND utilities > 0 AND coffee * 10 > utilities * 3
UNION ALL SELECT user_id, 'benchmark', 'saving_opportunity', 'tip', 'Potential Savings', NULL, CAST(total AS DOUBLE) - {BENCH_TOTAL}, NULL FROM w WHERE CAST(total AS DOUBLE) > {BENCH_TOTAL} * 1.2
UNION ALL SELECT user_id, 'subscriptions', 'subscription_alert', 'info', 'Active Subscriptions', NULL, CAST(subscription_total AS DOUBLE), NULL FROM s
UNION ALL SELECT user_id, 'high_category', 'category_alert', 'warning', 'High ' || category || ' Spending', category, CAST(total AS DOUBLE), (CAST(total AS DOUBLE) - bench) / bench * 100
 FROM ({TOTALS}) JOIN {BENCH} ON bcat = category WHERE CAST(total AS DOUBLE) > bench * 1.5
UNION ALL SELECT user_id, 'recurring', 'recurring_detection', 'info', 'Recurring: ' || payee, category, CAST(amount AS DOUBLE), NULL FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, payee) AS rank FROM (
 SELECT user_id, coalesce(nullif(merchant_name, ''), category) AS payee, first(category ORDER BY transaction_date, txn_id) AS category, first(amount ORDER BY transaction_date, txn_id) AS amount
 FROM {LABELLED_PERIOD} GROUP BY user_id, coalesce(nullif(merchant_name, ''), category), floor(amount)
 HAVING count(*) >= 2 AND max(day(transaction_date)) - min(day(transaction_date)) <= 5)) WHERE rank <= 3
""")
def _(i: Inputs):
    return ins.sort_insights(ins.spending_insights(_labelled(i), _professional(i), *YEAR))


# --- declared operators ---------------------------------------------------------------


@query("D2_peer_benchmark", """user_id bigint, category string, amount double, user_percentage double, average_amount double,
 average_percentage double, percentile bigint, status string""", f"""
WITH f AS ({TOTALS}), a AS (SELECT user_id, category, total AS amount FROM f UNION ALL SELECT user_id, 'All', sum(total) FROM f GROUP BY 1),
 g AS (SELECT category, CAST(sum(amount) AS DOUBLE) / count(*) AS av, sum(amount) AS ct FROM a GROUP BY 1)
SELECT a.user_id, a.category, amount, CAST(amount AS DOUBLE) / CAST((max(amount) FILTER (WHERE a.category = 'All') OVER (PARTITION BY a.user_id)) AS DOUBLE) * 100 AS user_percentage,
 av AS average_amount, CAST(ct AS DOUBLE) / CAST((SELECT ct FROM g WHERE category = 'All') AS DOUBLE) * 100 AS average_percentage,
 CAST(floor(percent_rank() OVER (PARTITION BY a.category ORDER BY amount) * 100) AS BIGINT) AS percentile,
 CASE WHEN CAST(amount AS DOUBLE) < av * 0.9 THEN 'below_average' WHEN CAST(amount AS DOUBLE) > av * 1.1 THEN 'above_average' ELSE 'average' END AS status
FROM a JOIN g ON a.category = g.category
""")
def _(i: Inputs):
    return d.peer_benchmark(_labelled(i), *YEAR)


@query("D4_recurring_transactions", """user_id bigint, merchant_name string, transaction_count bigint, amount double, frequency string,
 last_occurrence string, next_expected_date string, monthly_amount double""", """
WITH d AS (SELECT user_id, merchant_name, CAST(transaction_date AS DATE) AS day, sum(amount) AS amount, count(*) AS n FROM repeat_transactions
  WHERE NOT is_deleted AND transaction_type = 'DEBIT' AND merchant_name IS NOT NULL AND CAST(transaction_date AS DATE) BETWEEN DATE '1999-01-01' AND DATE '2000-06-15' GROUP BY 1, 2, 3),
 g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id, merchant_name ORDER BY day) AS gap FROM d),
 m AS (SELECT user_id, merchant_name, sum(n) AS c, sum(amount) AS t, max(day) AS l, quantile_cont(gap, 0.5) AS gap, count(*) AS k FROM g GROUP BY 1, 2)
SELECT user_id, merchant_name, c AS transaction_count, CAST(t AS DOUBLE) / c AS amount,
 CASE WHEN gap <= 10 THEN 'weekly' WHEN gap <= 20 THEN 'biweekly' WHEN gap <= 45 THEN 'monthly' WHEN gap <= 120 THEN 'quarterly' ELSE 'yearly' END AS frequency,
 l AS last_occurrence, l + CAST(floor(gap) AS INT) AS next_expected_date,
 CAST(t AS DOUBLE) / c * (CASE WHEN gap <= 10 THEN CAST(52 AS DOUBLE) / 12 WHEN gap <= 20 THEN CAST(26 AS DOUBLE) / 12 WHEN gap <= 45 THEN CAST(1 AS DOUBLE) WHEN gap <= 120 THEN CAST(1 AS DOUBLE) / 3 ELSE CAST(1 AS DOUBLE) / 12 END) AS monthly_amount
FROM m WHERE k >= 3
""")
def _(i: Inputs):
    return d.recurring_transactions(i.repeat_transactions, dt.date(1999, 1, 1), AS_OF)


@query("D6_category_tree", "category_id bigint, name string, is_income boolean, children string, rows bigint", """
SELECT c.category_id, c.name, c.is_income, (SELECT string_agg(k.name, ', ' ORDER BY k.display_order DESC, k.name) FROM categories k WHERE k.parent_id = c.category_id) AS children,
 (SELECT count(*) FROM transactions t JOIN categories k ON t.category_id = k.category_id WHERE coalesce(k.parent_id, k.category_id) = c.category_id) AS rows
FROM categories c WHERE c.parent_id IS NULL
""")
def _(i: Inputs):
    tree = d.category_tree(i.categories)
    member = i.categories.select("category_id", F.coalesce("parent_id", "category_id").alias("top"))
    rows = i.transactions.groupBy("category_id").count().join(member, "category_id").groupBy("top").agg(F.sum("count").alias("rows"))
    return tree.join(rows.withColumnRenamed("top", "category_id"), "category_id", "left").select(
        "category_id", "name", "is_income", F.array_join("children.name", ", ").alias("children"), "rows"
    )


@query("D6_category_stats", "user_id bigint, category_id bigint, name string, transaction_count bigint, total_amount double, percentage_of_total double", """
SELECT user_id, c.category_id, c.name, n AS transaction_count, s AS total_amount,
 CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY user_id) AS DOUBLE) * 100 AS percentage_of_total
FROM (SELECT user_id, category_id, count(*) AS n, sum(amount) AS s FROM transactions WHERE NOT is_deleted AND category_id IS NOT NULL GROUP BY 1, 2) t
JOIN categories c ON c.category_id = t.category_id
""")
def _(i: Inputs):
    return d.category_stats(i.transactions, i.categories)


@query("D8_profile_counts", "user_id bigint, transactions_count bigint, budgets_count bigint, categories_count bigint", """
SELECT u.user_id, coalesce(t, 0) AS transactions_count, coalesce(b, 0) AS budgets_count, coalesce(c, 0) AS categories_count
FROM (SELECT DISTINCT user_id FROM transactions WHERE NOT is_deleted UNION SELECT DISTINCT user_id FROM budgets UNION SELECT CAST(category_id AS BIGINT) FROM categories) u
LEFT JOIN (SELECT user_id, count(*) AS t FROM transactions WHERE NOT is_deleted GROUP BY 1) x ON x.user_id = u.user_id
LEFT JOIN (SELECT user_id, count(*) AS b FROM budgets GROUP BY 1) y ON y.user_id = u.user_id
LEFT JOIN (SELECT CAST(category_id AS BIGINT) AS user_id, count(*) AS c FROM categories GROUP BY 1) z ON z.user_id = u.user_id
""")
def _(i: Inputs):
    own = i.categories.select(F.col("category_id").cast("long").alias("user_id"))
    return d.profile_counts(i.transactions, i.budgets, own)


# --- dimension lookups over real rows ----------------------------------------------------


@query("F13_taxonomy_lookup", "tax_deductible boolean, category_type string, category string, n bigint, amount double", """
SELECT tax AS tax_deductible, kind AS category_type, category, count(*) AS n, sum(amount) AS amount FROM labelled
JOIN (VALUES ('Housing', 'expense', true), ('Utilities', 'expense', false), ('Transport', 'expense', false), ('Food & Dining', 'expense', false), ('Income', 'income', false)) x(cat, kind, tax) ON cat = category
WHERE NOT is_deleted AND subcategory NOT IN (SELECT name FROM categories WHERE parent_id IS NULL) AND category <> 'Uncategorized' GROUP BY 1, 2, 3
""")
def _(i: Inputs):
    rows = active(_labelled(i)).select("subcategory", "amount")
    facts = dim.taxonomy(i.spark).select("category", "category_type", "tax_deductible")
    parents = dim.parent_of_subcategory(i.spark).join(facts, "category")
    return (
        rows.groupBy("subcategory").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
        .join(parents, "subcategory")
        .groupBy("tax_deductible", "category_type", "category")
        .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    )


@query("F14_merchant_lookup", "merchant string, category string, subcategory string, is_subscription boolean, n bigint", """
SELECT k.merchant, k.category, k.subcategory, k.is_subscription, count(*) AS n
FROM (SELECT merchant, category, subcategory, is_subscription, min(keyword) AS kw FROM merchant_keywords GROUP BY 1, 2, 3, 4) k
JOIN transactions t ON contains(lower(t.description), CASE WHEN k.merchant = 'Blue Tokai' THEN 'tokai' ELSE k.kw END) WHERE k.category IN ('Food & Dining', 'Entertainment') GROUP BY 1, 2, 3, 4
""")
def _(i: Inputs):
    from spendlake.operators import matching

    words = i.merchant_keywords.filter(F.col("category").isin("Food & Dining", "Entertainment"))
    hits = matching.contains_matches(i.transactions.select("txn_id", "description"), "txn_id", "description", words)
    return hits.groupBy("merchant", "category", "subcategory", "is_subscription").agg(F.count("*").alias("n"))


PRICES = ", ".join(f"('{m[2]}', {m[5]}, {m[6]})" for m in dim.MERCHANTS)


@query("F15_amount_hints", "txn_id bigint, category string",
       f"SELECT DISTINCT txn_id, category FROM (SELECT txn_id, amount % 2000 AS a FROM transactions) JOIN (VALUES {PRICES}) m(category, low, high) ON a BETWEEN low AND high")
def _(i: Inputs):
    small = i.transactions.select("txn_id", (F.col("amount") % 2000).alias("amount"))
    return dim.amount_category_hints(small, dim.default_merchants(i.spark))


@query("A28_dictionary_usage", "category string, merchants bigint, keywords bigint, matched_rows bigint", """
SELECT category, count(DISTINCT merchant) AS merchants, count(DISTINCT keyword) AS keywords,
 (SELECT count(DISTINCT t.txn_id) FROM transactions t JOIN merchant_keywords m ON contains(lower(t.description), m.keyword) WHERE m.category = k.category) AS matched_rows
FROM merchant_keywords k GROUP BY category
""")
def _(i: Inputs):
    from spendlake.operators import matching

    sizes = i.merchant_keywords.groupBy("category").agg(
        F.count_distinct("merchant").alias("merchants"), F.count_distinct("keyword").alias("keywords")
    )
    hits = matching.contains_matches(i.transactions.select("txn_id", "description"), "txn_id", "description", i.merchant_keywords)
    used = hits.select("txn_id", "category").distinct().groupBy("category").agg(F.count("*").alias("matched_rows"))
    return sizes.join(used, "category", "left").withColumn("matched_rows", F.coalesce("matched_rows", F.lit(0)))


def _slug(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({name}), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"


SEED_ROWS = ", ".join(
    f"('{name}', {'NULL' if parent is None else repr(parent)}, {kind == 'income'}, {priority})"
    for category, (kind, priority, _tax) in dim.CATEGORIES.items()
    for name, parent in [(category, None), *((s, category) for s in dim.SUBCATEGORIES[category])]
)


@query("S35_seeded_categories", "name string, slug string, parent string, is_income boolean, display_order bigint, n bigint", f"""
SELECT v.name, {_slug("v.name")} AS slug, v.parent, v.is_income, v.display_order, coalesce(u.n, 0) AS n
FROM (VALUES {SEED_ROWS}) v(name, parent, is_income, display_order)
LEFT JOIN (SELECT subcategory, count(*) AS n FROM labelled WHERE NOT is_deleted GROUP BY 1) u ON u.subcategory = v.name
""")
def _(i: Inputs):
    seed = dim.seed_categories(dim.system_categories(i.spark).limit(0))
    parent = seed.filter("parent_id IS NULL").select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent"))
    used = active(_labelled(i)).groupBy(F.col("subcategory").alias("name")).agg(F.count("*").alias("n"))
    return seed.join(parent, "parent_id", "left").join(used, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
