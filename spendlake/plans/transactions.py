"""Filters, paging and joins over the transactions table."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendlake.operators import filters, ranking
from spendlake.operators.filters import TransactionFilter
from spendlake.plans.registry import Inputs, query

AS_OF = dt.date(2000, 6, 15)

ROW = "txn_id bigint, user_id bigint, amount double, transaction_date string"
ROW_SQL = "txn_id, user_id, amount, transaction_date"


@query("F1_active_rows", "user_id bigint, n bigint, amount double", """
SELECT user_id, count(*) AS n, sum(amount) AS amount FROM transactions WHERE NOT is_deleted GROUP BY user_id
""")
def _(i: Inputs):
    return filters.active(i.transactions).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("F2_equality_filters", ROW, f"""
SELECT {ROW_SQL} FROM transactions
WHERE NOT is_deleted AND category_id = 104 AND transaction_type = 'DEBIT' AND source = 'PDF' AND NOT is_recurring
""")
def _(i: Inputs):
    f = TransactionFilter(category_id=104, transaction_type="DEBIT", source="PDF", is_recurring=False)
    return f.apply(filters.active(i.transactions))


@query("F3_category_list", ROW, f"""
SELECT {ROW_SQL} FROM transactions WHERE NOT is_deleted AND category_id IN (102, 103, 1)
""")
def _(i: Inputs):
    return TransactionFilter(category_ids=[102, 103, 1]).apply(filters.active(i.transactions))


@query("F4_date_range", ROW, f"""
SELECT {ROW_SQL} FROM transactions
WHERE NOT is_deleted AND CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-10' AND DATE '2000-02-10'
""")
def _(i: Inputs):
    f = TransactionFilter(start_date=dt.date(2000, 1, 10), end_date=dt.date(2000, 2, 10))
    return f.apply(filters.active(i.transactions))


@query("F5_amount_range", ROW, f"""
SELECT {ROW_SQL} FROM transactions WHERE NOT is_deleted AND amount >= 1500.5 AND amount <= 25000
""")
def _(i: Inputs):
    f = TransactionFilter(min_amount=Decimal("1500.50"), max_amount=Decimal("25000.00"))
    return f.apply(filters.active(i.transactions))


@query("F6_text_search", ROW, f"""
SELECT {ROW_SQL} FROM transactions
WHERE NOT is_deleted AND (description ILIKE '%amaZON%' OR merchant_name ILIKE '%amaZON%')
""")
def _(i: Inputs):
    return TransactionFilter(search="amaZON").apply(filters.active(i.transactions))


@query("F7_search_newest", ROW + ", rank bigint", f"""
SELECT * FROM (
 SELECT {ROW_SQL}, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, txn_id DESC) AS rank
 FROM transactions
 WHERE NOT is_deleted AND (description ILIKE '%note%' OR merchant_name ILIKE '%note%' OR notes ILIKE '%note%')
) WHERE rank <= 20
""")
def _(i: Inputs):
    return filters.search_transactions(i.transactions, "note", 20)


@query("F8_point_lookup", ROW, f"""
SELECT {ROW_SQL} FROM transactions WHERE NOT is_deleted AND txn_id = 7 AND user_id = (SELECT user_id FROM transactions WHERE txn_id = 7)
""")
def _(i: Inputs):
    owner = i.transactions.filter("txn_id = 7").select("user_id").first()
    return filters.get_transaction(i.transactions, 7, owner["user_id"] if owner else -1)


@query("F9_visible_categories", "user_id bigint, category_count bigint", """
WITH c AS (SELECT category_id, category_id % 2 = 1 AS is_system, CAST(category_id AS BIGINT) % 50 AS user_id FROM categories),
 u AS (SELECT DISTINCT user_id FROM transactions)
SELECT u.user_id, count(*) AS category_count FROM u JOIN c ON c.is_system OR c.user_id = u.user_id GROUP BY u.user_id
""")
def _(i: Inputs):
    c = i.categories.select("category_id", (F.col("category_id") % 2 == 1).alias("is_system"), (F.col("category_id").cast("long") % 50).alias("user_id"))
    return filters.visible_category_counts(c, i.transactions.select("user_id").distinct())


@query("F10_transaction_view", "txn_id bigint, category_id bigint, category_name string, tag_count bigint, description string", """
SELECT t.txn_id, c.category_id, c.name AS category_name, 0 AS tag_count, t.description
FROM transactions t LEFT JOIN categories c ON t.category_id = c.category_id WHERE NOT t.is_deleted
""")
def _(i: Inputs):
    view = filters.transaction_view(i.transactions, i.categories)
    return view.select(
        "txn_id", F.col("category.id").alias("category_id"), F.col("category.name").alias("category_name"),
        F.size("tags").alias("tag_count"), "description",
    )


@query("F11_default_periods", "user_id bigint, month_rows bigint, trend_rows bigint", """
SELECT user_id, count(*) FILTER (WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2000-06-15') AS month_rows,
 count(*) AS trend_rows
FROM transactions
WHERE NOT is_deleted AND CAST(transaction_date AS DATE) BETWEEN DATE '1999-12-18' AND DATE '2000-06-15' GROUP BY user_id
""")
def _(i: Inputs):
    from spendlake.functions import money as m

    start, end = m.default_trend_period(AS_OF)
    month = m.period(*m.default_period(AS_OF))
    rows = filters.in_period(filters.active(i.transactions), start, end)
    return rows.groupBy("user_id").agg(m.count_if(month).alias("month_rows"), F.count("*").alias("trend_rows"))


@query("F12_null_predicates", "user_id bigint, uncategorized bigint, with_merchant bigint", """
SELECT user_id, count(*) FILTER (WHERE category_id IS NULL) AS uncategorized, count(merchant_name) AS with_merchant
FROM transactions WHERE NOT is_deleted GROUP BY user_id
""")
def _(i: Inputs):
    return filters.active(i.transactions).groupBy("user_id").agg(
        F.count(F.when(F.col("category_id").isNull(), 1)).alias("uncategorized"), F.count("merchant_name").alias("with_merchant")
    )


@query("J1_category_left_join", "category_name string, n bigint, amount double", """
SELECT c.name AS category_name, count(*) AS n, sum(t.amount) AS amount
FROM transactions t LEFT JOIN categories c ON t.category_id = c.category_id WHERE NOT t.is_deleted GROUP BY c.name
""")
def _(i: Inputs):
    view = filters.transaction_view(i.transactions, i.categories)
    return view.groupBy(F.col("category.name").alias("category_name")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


@query("K1_page", ROW + ", rank bigint", f"""
SELECT * FROM (
 SELECT {ROW_SQL}, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, created_at DESC, txn_id DESC) AS rank
 FROM transactions WHERE NOT is_deleted
) WHERE rank BETWEEN 26 AND 50
""")
def _(i: Inputs):
    return ranking.page(filters.active(i.transactions), 2, 25)


@query("K1_deep_rank", "txn_id bigint, user_id bigint, rank bigint", """
SELECT txn_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, created_at DESC, txn_id DESC) AS rank
FROM transactions WHERE NOT is_deleted
""")
def _(i: Inputs):
    order = [F.col("transaction_date").desc(), F.col("created_at").desc(), F.col("txn_id").desc()]
    return ranking.bucketed_rank(filters.active(i.transactions), ["user_id"], "transaction_date", order)


@query("K2_page_info", "user_id bigint, total bigint, page bigint, limit bigint, pages bigint, has_next boolean, has_prev boolean", """
SELECT user_id, count(*) AS total, 2 AS page, 50 AS "limit", CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages,
 2 < ceil(count(*) / 50.0) AS has_next, true AS has_prev
FROM transactions WHERE NOT is_deleted GROUP BY user_id
""")
def _(i: Inputs):
    return ranking.page_info(filters.active(i.transactions), 2, 50)


@query("D5_merchant_filter_sorted", ROW, f"""
SELECT {ROW_SQL} FROM transactions WHERE NOT is_deleted AND merchant_name ILIKE '%chant 3%'
""")
def _(i: Inputs):
    rows = TransactionFilter(merchant_name="chant 3").apply(filters.active(i.transactions))
    return filters.sort_transactions(rows, "amount", "asc")
