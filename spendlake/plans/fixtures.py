"""Views over the driver's tables. The same SQL text runs in Spark and in DuckDB.

``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "categories": """
SELECT * FROM (VALUES
 (1,'Housing','housing',CAST(NULL AS INT),false,90),(2,'Food & Dining','food-dining',NULL,false,75),
 (3,'Transport','transport',NULL,false,80),(4,'Utilities','utilities',NULL,false,85),
 (5,'Income','income',NULL,true,100),
 (100,'Rent','rent',1,false,90),(101,'Maintenance','maintenance',1,false,90),
 (102,'Groceries','groceries',2,false,75),(103,'Restaurants','restaurants',2,false,75),
 (104,'Food Delivery','food-delivery',2,false,75),(105,'Coffee/Tea','coffeetea',2,false,75),
 (106,'Petrol','petrol',3,false,80),(107,'Cab/Auto','cabauto',3,false,80),
 (108,'Metro','metro',3,false,80),(109,'Electricity','electricity',4,false,85),
 (110,'Internet','internet',4,false,85),(111,'Mobile Recharge','mobile-recharge',4,false,85),
 (112,'Salary','salary',5,true,100),(113,'Refund','refund',5,true,100)
) AS t(category_id, name, slug, parent_id, is_income, display_order)
""",
    "transactions": """
SELECT o_orderkey AS txn_id,
 o_custkey % 50 AS user_id,
 CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
 CASE WHEN o_orderstatus = 'P' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
 CASE WHEN o_orderkey % 15 = 14 THEN NULL
      WHEN o_orderkey % 11 = 0 THEN CAST(1 + o_orderkey % 5 AS INT)
      ELSE CAST(100 + o_orderkey % 14 AS INT) END AS category_id,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL
      ELSE concat('Merchant ', CAST(o_orderkey % 40 AS STRING)) END AS merchant_name,
 CASE CAST(o_orderkey % 6 AS INT)
      WHEN 0 THEN concat('UPI/', CAST(100000000000 + o_orderkey AS STRING), '/SWIGGY@ybl')
      WHEN 1 THEN concat('POS 4512XXXXXXXX1234 AMAZON ', o_orderpriority)
      WHEN 2 THEN 'NEFT/N0012345/SALARY JAN'
      WHEN 3 THEN 'Netflix monthly subscription'
      WHEN 4 THEN 'ATM WDL CASH'
      ELSE 'to blue tokai via upi' END AS description,
 CASE WHEN o_orderkey % 9 = 0 THEN concat('note ', o_orderpriority) ELSE NULL END AS notes,
 o_orderdate + (o_orderkey % 1440) * INTERVAL '1' MINUTE AS transaction_date,
 CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'CSV' WHEN 2 THEN 'PDF' ELSE 'EXCEL' END AS source,
 CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'HDFC' WHEN 1 THEN 'SBI' ELSE 'ICICI' END AS bank_name,
 (o_orderpriority = '5-LOW') AS is_recurring,
 (o_orderkey % 97 = 0) AS is_deleted,
 o_orderdate + INTERVAL '2' DAY AS created_at
FROM {orders}
""",
    "budgets": """
SELECT user_id * 10 AS budget_id, user_id, CAST(1 AS INT) AS category_id,
 CAST(100000 + user_id * 2500 AS DECIMAL(15,2)) AS amount_limit, 'monthly' AS period, CAST(0.8 AS DOUBLE) AS alert_threshold
FROM (SELECT DISTINCT o_custkey % 50 AS user_id FROM {orders}) u1
UNION ALL
SELECT user_id * 10 + 1, user_id, CAST(2 AS INT),
 CAST(100000 + user_id * 2500 AS DECIMAL(15,2)), 'monthly', CAST(0.8 AS DOUBLE)
FROM (SELECT DISTINCT o_custkey % 50 AS user_id FROM {orders}) u2
UNION ALL
SELECT user_id * 10 + 2, user_id, CAST(3 AS INT),
 CAST(100000 + user_id * 2500 AS DECIMAL(15,2)), 'weekly', CAST(0.8 AS DOUBLE)
FROM (SELECT DISTINCT o_custkey % 50 AS user_id FROM {orders}) u3
""",
    "statement_lines": """
SELECT concat('file', CAST(o_orderkey % 20 AS STRING)) AS file,
 o_orderkey AS line_no,
 CASE CAST(o_orderkey % 4 AS INT)
      WHEN 0 THEN concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '/2000')
      WHEN 1 THEN concat('2000-', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'))
      WHEN 2 THEN concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '-Jan-2000')
      ELSE 'n/a' END AS date_text,
 CASE CAST(o_orderkey % 3 AS INT)
      WHEN 0 THEN concat('  UPI/', CAST(100000000000 + o_orderkey AS STRING), '/SWIGGY@ybl  ref ')
      WHEN 1 THEN 'REFUND   FROM AMAZON' ELSE 'ATM WDL' END AS description,
 CASE CAST(o_orderkey % 7 AS INT)
      WHEN 0 THEN concat('Rs. ', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING))
      WHEN 1 THEN concat('(', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), ')')
      WHEN 2 THEN concat(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), ' DR')
      WHEN 3 THEN concat('INR ', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), ' CR')
      WHEN 4 THEN '1,23,456.78' WHEN 5 THEN '--'
      ELSE concat('-', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING)) END AS amount_text,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'DR' WHEN 1 THEN 'Cr' WHEN 2 THEN 'debit' ELSE NULL END AS type_text
FROM {orders}
""",
    "login_events": """
SELECT event_id, ts, user_id,
 (event_type <> 'error') AS success,
 concat('10.0.0.', CAST(event_id % 6 AS STRING)) AS ip,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Windows 11' WHEN 1 THEN 'MacIntel' WHEN 2 THEN 'Linux x86_64' ELSE 'iPhone' END AS platform
FROM {events}
""",
    "merchant_keywords": """
SELECT * FROM (VALUES
 (0,'Swiggy','swiggy','Food & Dining','Food Delivery',CAST(0.95 AS DOUBLE),false),
 (1,'Amazon','amazon','Shopping','Electronics',0.9,false),
 (2,'Netflix','netflix','Entertainment','OTT Subscriptions',0.95,true),
 (3,'Blue Tokai','blue tokai','Food & Dining','Coffee/Tea',0.95,false),
 (4,'Blue Tokai','tokai','Food & Dining','Coffee/Tea',0.95,false)
) AS t(ord, merchant, keyword, category, subcategory, confidence, is_subscription)
""",
    "benchmarks": """
SELECT * FROM (VALUES
 ('professional','Housing',20000),('professional','Utilities',4000),
 ('professional','Transport',6000),('professional','Food & Dining',12000)
) AS t(user_type, category, amount)
""",
    # Category and subcategory names on every row.
    "labelled": """
SELECT t.*, coalesce(p.name, c.name, 'Uncategorized') AS category, coalesce(c.name, 'Uncategorized') AS subcategory
FROM {transactions} t
LEFT JOIN {categories} c ON t.category_id = c.category_id
LEFT JOIN {categories} p ON c.parent_id = p.category_id
""",
    # Payments that repeat: fixed price and merchant, day of month within a few days.
    "repeat_transactions": """
SELECT txn_id, user_id, CAST(99 + 100 * (txn_id % 5) AS DECIMAL(15,2)) AS amount,
 CASE WHEN txn_id % 10 = 9 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type, category_id, merchant_name, description, notes,
 date_trunc('month', transaction_date) + (user_id % 20 + txn_id % 4) * INTERVAL '1' DAY AS transaction_date,
 source, bank_name, is_recurring, is_deleted, created_at
FROM {transactions}
""",
    # Every transaction, plus a changed copy of every 10th.
    "near_copies": """
SELECT txn_id, user_id, amount, transaction_type, description, transaction_date FROM {transactions}
UNION ALL
SELECT txn_id + 10000000, user_id, CASE WHEN txn_id % 20 = 0 THEN CAST(amount + 0.01 AS DECIMAL(15,2)) ELSE amount END,
 transaction_type, replace(description, 'A', 'B'), transaction_date
FROM {transactions} WHERE txn_id % 10 = 0
""",
    # Every transaction, plus an unchanged copy of every 10th.
    "exact_copies": """
SELECT txn_id, user_id, amount, transaction_type, description, transaction_date FROM {transactions}
UNION ALL
SELECT txn_id + 10000000, user_id, amount, transaction_type, description, transaction_date
FROM {transactions} WHERE txn_id % 10 = 0
""",
    # Delimited files of 100 rows: a title, a blank line, a header (six formats), then rows.
    "csv_lines": """
SELECT concat('file', CAST(f AS STRING)) AS file, n AS line_no, line FROM (
 SELECT DISTINCT f, 0 AS n, CASE CAST(f % 4 AS INT) WHEN 0 THEN 'HDFC BANK statement' WHEN 1 THEN 'State Bank of India' WHEN 2 THEN 'PhonePe history' ELSE 'My export' END AS line
 FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) a
 UNION ALL SELECT DISTINCT f, 1, '' FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) b
 UNION ALL SELECT DISTINCT f, 2, CASE CAST(f % 6 AS INT) WHEN 0 THEN 'Date,Description,Amount,Type,Balance' WHEN 1 THEN 'Date;Narration;Withdrawal Amt.;Deposit Amt.;Closing Balance'
   WHEN 2 THEN concat_ws(chr(9), 'Date', 'Description', 'Amount', 'Dr / Cr', 'Balance') WHEN 3 THEN 'Txn Dt|Particulars of txn|Debit Amt|Credit Amt|Bal'
   WHEN 4 THEN 'Date,Payee Name,Amount,Transaction Type,UTR' ELSE 'Value Date,Transaction Remarks,Withdrawal Amount (INR ),Deposit Amount (INR ),Balance (INR )' END
 FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) c
 UNION ALL SELECT f, 3 + k % 100, CASE CAST(f % 6 AS INT) WHEN 0 THEN concat_ws(',', d, s, m, CASE WHEN k % 3 = 0 THEN 'CR' ELSE 'DR' END, '5000.00')
   WHEN 1 THEN concat_ws(';', d, s, CASE WHEN k % 3 = 0 THEN '' ELSE m END, CASE WHEN k % 3 = 0 THEN m ELSE '' END, '5000.00')
   WHEN 2 THEN concat_ws(chr(9), d, s, m, CASE WHEN k % 3 = 0 THEN 'CR' ELSE 'DR' END, '5000.00')
   WHEN 3 THEN concat_ws('|', d, s, CASE WHEN k % 3 = 0 THEN '' ELSE m END, CASE WHEN k % 3 = 0 THEN m ELSE '' END, '5000.00')
   WHEN 4 THEN concat_ws(',', d, s, m, CASE WHEN k % 3 = 0 THEN 'CREDIT' ELSE 'DEBIT' END, CASE WHEN k % 5 = 0 THEN '' ELSE concat('UTR', CAST(k AS STRING)) END)
   ELSE concat_ws(',', d, s, CASE WHEN k % 3 = 0 THEN '' ELSE m END, CASE WHEN k % 3 = 0 THEN m ELSE '' END, '5000.00') END
 FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) AS m,
   CASE WHEN o_orderkey % 50 = 7 THEN 'n/a' ELSE concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + o_orderkey % 6 AS STRING), 2, '0'), '/2000') END AS d,
   CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'REFUND FROM AMAZON' WHEN 1 THEN concat('NEFT-N', CAST(o_orderkey AS STRING), ' RENT') ELSE 'ATM WDL' END AS s FROM {orders}) r
) x
""",
    # Statement text of 100 rows per file: a bank line, then lines in that bank's layout.
    "text_lines": """
SELECT concat('stmt', CAST(f AS STRING)) AS file, n AS line_no, line FROM (
 SELECT DISTINCT f, 0 AS n, CASE CAST(f % 7 AS INT) WHEN 0 THEN 'HDFC BANK LTD' WHEN 1 THEN 'STATE BANK OF INDIA' WHEN 2 THEN 'ICICI BANK' WHEN 3 THEN 'Axis Bank'
   WHEN 4 THEN 'KOTAK MAHINDRA BANK' WHEN 5 THEN 'Village cooperative' ELSE 'ICICI BANK paid via GPay' END AS line
 FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) a
 UNION ALL SELECT f, 1 + k % 100, CASE WHEN k % 11 = 5 THEN concat('Page ', CAST(k AS STRING)) ELSE CASE CAST(f % 7 AS INT)
   WHEN 0 THEN CASE WHEN k % 2 = 0 THEN concat(d, '  ', s, '  ', CAST(100000 + k AS STRING), '  ', d, '  ', m, '  45,000.00') ELSE concat(d, '  ', s, '  ', m, '  DR  45,000.00') END
   WHEN 1 THEN CASE WHEN k % 2 = 0 THEN concat(e, ' ', e, '  ', s, '  ', CAST(100000 + k AS STRING), '  ', m, '    45000.00') ELSE concat(d, '  ', s, '  ', m, ' CR 45000.00') END
   WHEN 2 THEN concat(CAST(1 + k % 100 AS STRING), '  ', d, '  ', d, '  --  ', s, '  ', m, '    45,000.00')
   WHEN 3 THEN concat(g, '  ', CAST(k AS STRING), '  ', s, '  ', m, '    45000.00')
   WHEN 4 THEN concat(d, ' ', s, ' ', m, CASE WHEN k % 3 = 0 THEN ' CR ' ELSE ' DR ' END, '45000.00')
   ELSE CASE WHEN k % 3 = 0 THEN concat(d, ' ', s, ' ', m, ' CR 45000.00') WHEN k % 3 = 1 THEN concat(e, ' ', s, ' ', m, ' DR 45000.00') ELSE concat(d, ' ', s, ' ', m) END END END
 FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) AS m,
   concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + o_orderkey % 6 AS STRING), 2, '0'), '/2000') AS d,
   concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), ' Jan 2000') AS e, concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '-Feb-2000') AS g,
   CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'REFUND FROM AMAZON' WHEN 1 THEN concat('NEFT-N', CAST(o_orderkey AS STRING), ' RENT') ELSE 'ATM WDL' END AS s FROM {orders}) r
) x
""",
    # Spreadsheet cells: a bank cell, a header row, then four columns per row.
    "sheet_cells": """
SELECT concat('book', CAST(f AS STRING)) AS file, 'Sheet1' AS sheet, r AS row, c AS col, v AS value FROM (
 SELECT DISTINCT f, 1 AS r, 1 AS c, CASE CAST(f % 3 AS INT) WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'Statement of SBI' ELSE 'Export' END AS v FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) a
 UNION ALL SELECT DISTINCT f, 3, 1, 'Txn Date' FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) b
 UNION ALL SELECT DISTINCT f, 3, 2, 'Narration' FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) c
 UNION ALL SELECT DISTINCT f, 3, 3, CASE WHEN f % 2 = 0 THEN 'Withdrawal Amt' ELSE 'Amount' END FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) d
 UNION ALL SELECT DISTINCT f, 3, 4, CASE WHEN f % 2 = 0 THEN 'Deposit Amt' ELSE 'Cr/Dr' END FROM (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f FROM {orders}) e
 UNION ALL SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT), 4 + o_orderkey % 100, 1, concat('2000-', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')) FROM {orders} g
 UNION ALL SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT), 4 + o_orderkey % 100, 2, concat('POS  shop ', CAST(o_orderkey AS STRING)) FROM {orders} h
 UNION ALL SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT), 4 + o_orderkey % 100, 3, CASE WHEN floor(o_orderkey / 100.0) % 2 = 0 AND o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) END FROM {orders} i
 UNION ALL SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT), 4 + o_orderkey % 100, 4, CASE WHEN floor(o_orderkey / 100.0) % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) END
   ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'CR' WHEN o_orderkey % 3 = 1 THEN 'DR' END END FROM {orders} j
) x
""",
}


def _needs(text: str) -> list[str]:
    """Views named in ``text``, in the order in which they have to be defined."""
    return [n for n in VIEWS if re.search(rf"\b{n}\b", text)]


def with_clause(sql: str) -> str:
    """The WITH clause that defines every view used by ``sql``."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += _needs(VIEWS[name].replace("{", "").replace("}", ""))
    if not wanted:
        return ""
    ordered = [n for n in VIEWS if n in wanted]
    parts = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n]).strip()})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n"
