"""Cleaning, extraction, formatting and data-quality functions over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions import quality as q
from spendlake.functions import text as x
from spendlake.operators import matching
from spendlake.plans.registry import Inputs, query

AS_OF = dt.date(2001, 12, 31)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first_of(column: str, patterns: list[str]) -> str:
    """coalesce over group 1 of each pattern."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, {lit(p)}, 1), '')" for p in patterns) + ")"


def cases(column: str, rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {lit('(?i)' + p)}) THEN {lit(n)}" for p, n in rules) + f" ELSE {otherwise} END"


AMOUNT_SQL = r"""
SELECT file, line_no, amount_text, CASE WHEN lower(trim(amount_text)) IN ('null', 'none', '-', '--', 'n/a', '') THEN NULL
 WHEN amount_text LIKE '(%)' OR amount_text LIKE '-%' OR contains(upper(amount_text), 'DR') THEN -abs(num) ELSE num END AS amount
FROM (SELECT *, TRY_CAST(regexp_replace(regexp_replace(regexp_replace(amount_text, '^[(-]', ''), '(?i)\brs\.?\s*', ''), '[^0-9.-]', '', 'g') AS DOUBLE) AS num FROM statement_lines)
"""


@query("C1_clean_amount", "file string, line_no bigint, amount_text string, amount double", AMOUNT_SQL)
def _(i: Inputs):
    return i.statement_lines.withColumn("amount", x.clean_amount(F.col("amount_text")))


@query("C2_clean_date", "line_no bigint, date_text string, day string", """
SELECT line_no, date_text, CAST(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%d-%b-%Y')) AS DATE) AS day FROM statement_lines
""")
def _(i: Inputs):
    return i.statement_lines.withColumn("day", x.clean_date(F.col("date_text"), AS_OF))


@query("C3_clean_description", "line_no bigint, description string", r"""
SELECT line_no, CASE WHEN regexp_matches(s, '(?i)^UPI[-/](\d+)[-/]([^@/]+)') THEN 'UPI - ' || trim(regexp_extract(s, '(?i)^UPI[-/](\d+)[-/]([^@/]+)', 2)) || ' (' || s || ')' ELSE s END AS description
FROM (SELECT line_no, trim(regexp_replace(description, '\s+', ' ', 'g')) AS s FROM statement_lines)
""")
def _(i: Inputs):
    return i.statement_lines.withColumn("description", x.clean_description(F.col("description")))


@query("C4_extract_reference", "txn_id bigint, reference string",
       f"SELECT txn_id, {first_of('description', v.REFERENCE_PATTERNS)} AS reference FROM transactions")
def _(i: Inputs):
    return i.transactions.withColumn("reference", x.extract_reference(F.col("description")))


def contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


@query("C5_transaction_type", "line_no bigint, transaction_type string", f"""
SELECT line_no, CASE WHEN upper(trim(type_text)) IN ('CR', 'C', 'CREDIT', '+') THEN 'CREDIT' WHEN upper(trim(type_text)) IN ('DR', 'D', 'DEBIT', '-') THEN 'DEBIT'
 WHEN amount < 0 THEN 'DEBIT' WHEN amount > 0 THEN 'CREDIT'
 WHEN {contains_any('upper(description)', v.DEBIT_KEYWORDS)} THEN 'DEBIT' WHEN {contains_any('upper(description)', v.CREDIT_KEYWORDS)} THEN 'CREDIT' ELSE 'UNKNOWN' END AS transaction_type
FROM (SELECT l.*, a.amount FROM statement_lines l JOIN ({AMOUNT_SQL}) a USING (file, line_no))
""")
def _(i: Inputs):
    amount = x.clean_amount(F.col("amount_text"))
    return i.statement_lines.withColumn(
        "transaction_type", x.transaction_type(F.col("description"), amount, indicator=F.col("type_text"))
    )


@query("C6_bank_name", "txn_id bigint, raw string, bank string", "SELECT txn_id, raw, " + "CASE " + " ".join(
    f"WHEN {contains_any('upper(raw)', words)} THEN {lit(name)}" for name, words in v.BANK_NAMES) + """ ELSE upper(trim(raw)) END AS bank
FROM (SELECT txn_id, CASE txn_id % 5 WHEN 0 THEN lower(bank_name) || ' bank ltd' WHEN 1 THEN 'State Bank of India' WHEN 2 THEN ' Ratnakar Bank ' WHEN 3 THEN 'Some Coop ' || bank_name ELSE ' local coop ' END AS raw FROM transactions)
""")
def _(i: Inputs):
    raw = F.expr("""CASE CAST(txn_id % 5 AS INT) WHEN 0 THEN concat(lower(bank_name), ' bank ltd') WHEN 1 THEN 'State Bank of India'
      WHEN 2 THEN ' Ratnakar Bank ' WHEN 3 THEN concat('Some Coop ', bank_name) ELSE ' local coop ' END""")
    return i.transactions.select("txn_id", raw.alias("raw")).withColumn("bank", x.normalize_bank_name(F.col("raw")))


@query("C7_account_number", "txn_id bigint, account string, masked string, starred string", """
SELECT txn_id, account, CASE WHEN account IS NULL THEN '' ELSE 'XXXX-XXXX-' || right(account, 4) END AS masked, repeat('*', length(account) - 4) || right(account, 4) AS starred
FROM (SELECT txn_id, coalesce(nullif(regexp_extract(raw, '(?i)A/C\\s*(?:NO\\.?)?\\s*[:.]?\\s*(\\d{9,18})', 1), ''), nullif(regexp_extract(raw, '(\\d{9,18})', 1), '')) AS account
FROM (SELECT txn_id, CASE WHEN txn_id % 3 = 0 THEN 'A/C No: ' || CAST(50100000000 + txn_id AS VARCHAR) WHEN txn_id % 3 = 1 THEN 'ref 12345678 ' || CAST(900000000000 + txn_id AS VARCHAR) ELSE description END AS raw FROM transactions))
""".replace("\\\\", "\\"))
def _(i: Inputs):
    raw = F.expr("""CASE WHEN txn_id % 3 = 0 THEN concat('A/C No: ', CAST(50100000000 + txn_id AS STRING))
      WHEN txn_id % 3 = 1 THEN concat('ref 12345678 ', CAST(900000000000 + txn_id AS STRING)) ELSE description END""")
    account = x.extract_account_number(raw)
    return i.transactions.select("txn_id", account.alias("account")).select(
        "txn_id", "account", x.mask_account_number(F.col("account")).alias("masked"), x.mask_all_but_last4(F.col("account")).alias("starred")
    )


@query("C8_description_class", "txn_id bigint, class string",
       f"SELECT txn_id, {cases('description', [(p, n) for n, p in v.DESCRIPTION_CLASSES], lit('Other'))} AS class FROM transactions")
def _(i: Inputs):
    return i.transactions.withColumn("class", x.description_class(F.col("description")))


@query("C9_canonical_merchant", "txn_id bigint, canonical string",
       f"SELECT txn_id, {cases('description', v.CANONICAL_MERCHANTS)} AS canonical FROM transactions")
def _(i: Inputs):
    return i.transactions.withColumn("canonical", x.canonical_merchant(F.col("description")))


def normalized_sql(column: str) -> str:
    s = f"trim(lower({column}))"
    for p in v.NORMALIZE_PATTERNS:
        s = f"regexp_replace({s}, {lit(p)}, '', 'gi')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


NORMALIZED = f"SELECT txn_id, description, {normalized_sql('description')} AS normalized FROM transactions"
KEYWORDS = ("list_filter(regexp_extract_all(normalized, '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains(["
            + ", ".join(map(lit, v.NOISE_WORDS)) + "], w))")


@query("C10_normalize", "txn_id bigint, normalized string", f"SELECT txn_id, normalized FROM ({NORMALIZED})")
def _(i: Inputs):
    return i.transactions.withColumn("normalized", x.normalize_description(F.col("description")))


@query("C11_keywords", "txn_id bigint, keywords string",
       f"SELECT txn_id, array_to_string({KEYWORDS}, ' ') AS keywords FROM ({NORMALIZED})")
def _(i: Inputs):
    words = x.keywords(x.normalize_description(F.col("description")))
    return i.transactions.withColumn("keywords", F.array_join(words, " "))


@query("C12_upi_id", "txn_id bigint, upi_id string",
       f"SELECT txn_id, {first_of('lower(description)', v.UPI_ID_PATTERNS)} AS upi_id FROM transactions")
def _(i: Inputs):
    return i.transactions.withColumn("upi_id", x.extract_upi_id(F.col("description")))


def title(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


GUESS = "coalesce(" + ", ".join(
    f"CASE WHEN length(trim(regexp_extract(normalized, {lit(p)}, 1))) >= 3 THEN {title(f'trim(regexp_extract(normalized, {lit(p)}, 1))')} END"
    for p in v.MERCHANT_NAME_PATTERNS) + f", {title(f'({KEYWORDS})[1]')})"


@query("C13_merchant_guess", "txn_id bigint, merchant string", f"SELECT txn_id, {GUESS} AS merchant FROM ({NORMALIZED})")
def _(i: Inputs):
    return i.transactions.withColumn("merchant", x.merchant_name_guess(x.normalize_description(F.col("description"))))


BEST_CONTAINED = """
SELECT txn_id, merchant, is_subscription, confidence FROM (
SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY confidence DESC, ord) AS rk FROM (
SELECT t.txn_id, k.merchant, k.is_subscription, min(k.ord) AS ord,
 first(least(0.95, k.confidence * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (length(k.keyword) / length(t.description)))) ORDER BY k.ord) AS confidence
FROM transactions t JOIN merchant_keywords k ON contains(lower(t.description), k.keyword) GROUP BY t.txn_id, k.merchant, k.is_subscription)) WHERE rk = 1
"""


@query("C14_extract_merchant", "txn_id bigint, merchant string", f"""
SELECT n.txn_id, coalesce(b.merchant, {GUESS}) AS merchant FROM ({NORMALIZED}) n LEFT JOIN ({BEST_CONTAINED}) b ON b.txn_id = n.txn_id
""")
def _(i: Inputs):
    from spendlake.operators.categorize import extract_merchant

    return extract_merchant(i.transactions.select("txn_id", "description"), "txn_id", i.merchant_keywords)


@query("C15_time_hints", "txn_id bigint, weekend boolean, part string, hints string", """
SELECT txn_id, weekend, part, concat_ws(', ', CASE WHEN weekend THEN 'Restaurants 0.1, Movies/Cinema 0.1, Clothes/Apparel 0.05' END,
 CASE WHEN part = 'morning' THEN 'Coffee/Tea 0.1, Cab/Auto 0.1' END, CASE WHEN part = 'evening' THEN 'Food Delivery 0.1, Restaurants 0.1' END,
 CASE WHEN day(ts) <= 5 THEN 'Rent 0.15, Salary 0.15' END, CASE WHEN day(ts) >= 25 THEN 'EMI Payment 0.1, Credit Card Bill 0.1' END) AS hints
FROM (SELECT txn_id, transaction_date AS ts, isodow(transaction_date) >= 6 AS weekend,
 CASE WHEN hour(transaction_date) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(transaction_date) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(transaction_date) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS part FROM transactions)
""")
def _(i: Inputs):
    ts = F.col("transaction_date")
    hints = F.transform(x.time_hints(ts), lambda h: F.concat_ws(" ", h["subcategory"], h["confidence"].cast("string")))
    return i.transactions.select(
        "txn_id", x.is_weekend(ts).alias("weekend"), x.time_of_day(ts).alias("part"), F.array_join(hints, ", ").alias("hints")
    )


@query("C16_subscription_merchant", "txn_id bigint, is_subscription boolean",
       f"SELECT t.txn_id, coalesce(b.is_subscription, false) AS is_subscription FROM transactions t LEFT JOIN ({BEST_CONTAINED}) b ON b.txn_id = t.txn_id")
def _(i: Inputs):
    best = matching.best_contained(i.transactions, "txn_id", "description", i.merchant_keywords)
    return i.transactions.select("txn_id").join(best.select("txn_id", "is_subscription"), "txn_id", "left").withColumn(
        "is_subscription", F.coalesce("is_subscription", F.lit(False))
    )


PROBE = "CASE CAST(txn_id % 4 AS INT) WHEN 0 THEN ' Swiggy ' WHEN 1 THEN 'NETFLIX' WHEN 2 THEN 'tokai' ELSE description END"


@query("C17_exact_keyword", "txn_id bigint, merchant string", f"""
SELECT txn_id, merchant FROM (SELECT txn_id, lower(trim({PROBE})) AS p FROM transactions) JOIN merchant_keywords ON keyword = p
""")
def _(i: Inputs):
    probe = i.transactions.select("txn_id", F.expr(PROBE).alias("p"))
    return matching.exact_keyword(probe, "txn_id", "p", i.merchant_keywords)


@query("C18_slug", "txn_id bigint, slug string", r"""
SELECT txn_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(description || ' / ' || coalesce(merchant_name, '_')), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM transactions
""")
def _(i: Inputs):
    return i.transactions.withColumn("slug", x.slug(F.concat("description", F.lit(" / "), F.coalesce("merchant_name", F.lit("_")))))


KEY_SQL = "md5(CAST(CAST(transaction_date AS DATE) AS VARCHAR) || '|' || CAST(CAST(amount AS DECIMAL(20,2)) AS VARCHAR) || '|' || transaction_type || '|' || substring(description, 1, 50))"


@query("C19_hashes", "txn_id bigint, sha string, key string", f"SELECT txn_id, sha256(description) AS sha, {KEY_SQL} AS key FROM transactions")
def _(i: Inputs):
    key = x.transaction_key(F.to_date("transaction_date"), F.col("amount"), F.col("transaction_type"), F.col("description"))
    return i.transactions.select("txn_id", x.sha256_hex(F.col("description")).alias("sha"), key.alias("key"))


CURRENCY = "CASE CAST(txn_id % 6 AS INT) WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' WHEN 4 THEN 'INR' ELSE 'CHF' END"


@query("C20_format_currency", "txn_id bigint, text string, indian string", f"""
SELECT txn_id, CASE c WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'JPY' THEN '¥' WHEN 'INR' THEN '₹' ELSE c END
 || CASE WHEN c = 'JPY' THEN format('{{:,.0f}}', a) ELSE format('{{:,.2f}}', a) END AS text,
 '₹' || CASE WHEN b >= 10000000 THEN format('{{:.2f}} Cr', b / 10000000) WHEN b >= 100000 THEN format('{{:.2f}} L', b / 100000) WHEN b >= 1000 THEN format('{{:,.0f}}', b) ELSE format('{{:.2f}}', b) END AS indian
FROM (SELECT txn_id, CAST(amount AS DOUBLE) AS a, CAST(CASE WHEN txn_id % 3 = 0 THEN amount % 900 ELSE amount * (1 + txn_id % 40) END AS DOUBLE) AS b, {CURRENCY} AS c FROM transactions)
""")
def _(i: Inputs):
    big = F.expr("CASE WHEN txn_id % 3 = 0 THEN CAST(amount % 900 AS DOUBLE) ELSE CAST(amount * (1 + txn_id % 40) AS DOUBLE) END")
    return i.transactions.select(
        "txn_id", x.format_currency(F.col("amount").cast("double"), F.expr(CURRENCY)).alias("text"), x.format_indian(big).alias("indian")
    )


EMAIL = """CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat(lower(replace(c_name, '#', '.')), '@Example.com ') WHEN 1 THEN concat('a@', lower(c_mktsegment), '.in')
 WHEN 2 THEN c_name WHEN 3 THEN concat('x..y@mail', CAST(c_custkey AS STRING), '.org') ELSE concat('<ab>', CAST(c_custkey AS STRING), '@mail.co') END"""


@query("C22_mask_and_truncate", "c_custkey bigint, masked string, short string", f"""
SELECT c_custkey, CASE WHEN NOT contains(e, '@') THEN e ELSE l[1] || '***' || CASE WHEN length(l) <= 2 THEN '' ELSE right(l, 1) END || '@' || d END AS masked,
 CASE WHEN length(e) <= 20 THEN e ELSE left(e, 17) || '...' END AS short
FROM (SELECT c_custkey, e, regexp_extract(e, '^(.*)@([^@]*)$', 1) AS l, regexp_extract(e, '^(.*)@([^@]*)$', 2) AS d FROM (SELECT c_custkey, {EMAIL} AS e FROM customer))
""")
def _(i: Inputs):
    rows = i.table("customer").select("c_custkey", F.expr(EMAIL).alias("e"))
    return rows.select("c_custkey", x.mask_email(F.col("e")).alias("masked"), x.truncate(F.col("e"), 20).alias("short"))


@query("C23_text_hygiene", "page_id bigint, escaped string, squeezed string, bare string, filename string", r"""
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
 sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS squeezed,
 sha256(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS bare,
 regexp_replace(regexp_replace(regexp_replace(url, '[/\\\x00-\x1f\x7f]', '', 'g'), '[<>:"|?*]', '_', 'g'), '^\.+', '') AS filename FROM pages
""")
def _(i: Inputs):
    h = F.col("html")
    return i.table("pages").select(
        "page_id", F.sha2(q.escape_html(h), 256).alias("escaped"), F.sha2(x.squeeze(h), 256).alias("squeezed"),
        F.sha2(q.remove_control_characters(h), 256).alias("bare"), q.sanitize_filename(F.col("url")).alias("filename"),
    )


@query("C23_strip_html", "page_id bigint, text string, nfc_text string")
def _(i: Inputs):
    bare = q.strip_html(F.col("html"))
    return i.table("pages").select("page_id", bare.alias("text"), q.normalize_nfc(F.col("html")).alias("nfc_text"))


@query("C24_validate_email", "c_custkey bigint, value string, errors string", f"""
SELECT c_custkey, s AS value, concat_ws('; ', CASE WHEN NOT regexp_matches(s, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') THEN 'email is not a valid email address' END,
 CASE WHEN contains(s, '..') OR starts_with(s, '.') OR ends_with(s, '.') THEN 'email has invalid format' END, CASE WHEN length(s) > 254 THEN 'email is too long' END) AS errors
FROM (SELECT c_custkey, regexp_replace(lower(trim({EMAIL})), '[<>"'']', '', 'g') AS s FROM customer)
""")
def _(i: Inputs):
    r = q.validate_email(F.expr(EMAIL))
    return i.table("customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.value", F.concat_ws("; ", "r.errors").alias("errors"))


PHONE = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('+91 98', CAST(10000000 + c_custkey AS STRING)) WHEN 1 THEN concat('(0', CAST(c_custkey AS STRING), ')') WHEN 2 THEN '' ELSE concat('9', CAST(c_custkey AS STRING), '-555') END"


@query("C24_validate_phone", "c_custkey bigint, value string, errors string", f"""
SELECT c_custkey, CASE WHEN p <> '' THEN s END AS value, CASE WHEN p = '' THEN 'phone is required' WHEN NOT regexp_matches(s, '^\\+?[1-9]\\d{{1,14}}$') THEN 'phone is not a valid phone number' ELSE '' END AS errors
FROM (SELECT c_custkey, p, CASE WHEN p LIKE '+%' THEN '+' ELSE '' END || regexp_replace(p, '\\D', '', 'g') AS s FROM (SELECT c_custkey, {PHONE} AS p FROM customer))
""")
def _(i: Inputs):
    r = q.validate_phone(F.expr(PHONE))
    return i.table("customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.value", F.concat_ws("; ", "r.errors").alias("errors"))


@query("C24_validate_amount", "line_no bigint, value double, errors string", """
SELECT line_no, round(n, 2) AS value, concat_ws('; ', CASE WHEN n IS NULL THEN 'amount must be a valid number' END, CASE WHEN n < 0 THEN 'amount cannot be negative' END,
 CASE WHEN n < 0 THEN 'amount must be at least 0' END, CASE WHEN n > 9999999999.99 THEN 'amount must not exceed 9999999999.99' END) AS errors
FROM (SELECT line_no, TRY_CAST(regexp_replace(amount_text, '[^0-9.-]', '', 'g') AS DECIMAL(38,10)) AS n FROM statement_lines)
""")
def _(i: Inputs):
    r = q.validate_amount(F.col("amount_text"), currency="INR")
    return i.statement_lines.select("line_no", r.alias("r")).select("line_no", "r.value", F.concat_ws("; ", "r.errors").alias("errors"))


@query("C24_validate_date", "line_no bigint, value string, errors string", """
SELECT line_no, d AS value, CASE WHEN d IS NULL THEN 'date has invalid date format' WHEN d > DATE '2000-06-15' THEN 'date cannot be in the future' ELSE '' END AS errors
FROM (SELECT line_no, CAST(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%Y/%m/%d')) AS DATE) AS d FROM statement_lines)
""")
def _(i: Inputs):
    r = q.validate_date(F.col("date_text"), dt.date(2000, 6, 15), allow_future=False)
    return i.statement_lines.select("line_no", r.alias("r")).select("line_no", "r.value", F.concat_ws("; ", "r.errors").alias("errors"))


ANY_SQL = lit("(?i)" + "|".join(f"(?:{p})" for p in v.SQL_INJECTION_PATTERNS))
ANY_MARKUP = lit("(?i)" + "|".join(f"(?:{p})" for p in v.MARKUP_PATTERNS))


@query("C24_validate_string", "conv_id bigint, turn bigint, errors string", f"""
SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'text is required' ELSE concat_ws('; ', CASE WHEN length(s) < 10 THEN 'text must be at least 10 characters' END,
 CASE WHEN length(s) > 400 THEN 'text must not exceed 400 characters' END, CASE WHEN regexp_matches(s, {ANY_SQL}) THEN 'text contains invalid characters' END,
 CASE WHEN regexp_matches(s, {ANY_MARKUP}) THEN 'text contains invalid content' END) END AS errors
FROM (SELECT conv_id, turn, text, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS s FROM conversations)
""")
def _(i: Inputs):
    r = q.validate_string(F.col("text"), "text", 10, 400)
    return i.table("conversations").select("conv_id", "turn", r.alias("r")).select(
        "conv_id", "turn", F.concat_ws("; ", "r.errors").alias("errors")
    )


UUID_TEXT = """CASE CAST(txn_id % 4 AS INT) WHEN 0 THEN md5(CAST(txn_id AS STRING)) WHEN 1 THEN concat('{', md5(CAST(txn_id AS STRING)), '}')
 WHEN 2 THEN concat('urn:uuid:', upper(md5(CAST(txn_id AS STRING)))) ELSE concat('x', md5(CAST(txn_id AS STRING))) END"""
UUID_SQL = "CASE WHEN regexp_matches(h, '^[0-9a-f]{32}$') THEN concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) END"


@query("C26_safe_uuid", "txn_id bigint, uuid string, strict_errors string", f"""
SELECT txn_id, {UUID_SQL} AS uuid, CASE WHEN {UUID_SQL} IS NULL THEN 'id is required' WHEN NOT regexp_matches({UUID_SQL}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') THEN 'id is not a valid UUID' ELSE '' END AS strict_errors
FROM (SELECT txn_id, lower(regexp_replace(regexp_replace({UUID_TEXT}, 'urn:|uuid:', '', 'g'), '^[{{}}]+|[{{}}]+$|-', '', 'g')) AS h FROM transactions)
""")
def _(i: Inputs):
    rows = i.transactions.select("txn_id", x.safe_uuid(F.expr(UUID_TEXT)).alias("uuid"))
    return rows.withColumn("strict_errors", F.concat_ws("; ", q.validate_uuid(F.col("uuid"))["errors"]))


ACCOUNT = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('gb-82 ', CAST(c_custkey AS STRING)) WHEN 1 THEN CAST(c_custkey % 100 AS STRING) WHEN 2 THEN concat('AB;', CAST(c_custkey AS STRING)) ELSE concat('acc', CAST(10000 + c_custkey AS STRING)) END"


@query("C24_validate_account", "c_custkey bigint, value string, errors string", f"""
SELECT c_custkey, upper(s) AS value, concat_ws('; ', CASE WHEN NOT regexp_matches(s, '^[a-zA-Z0-9]+$') THEN 'account_number contains invalid characters' END,
 CASE WHEN length(s) < 4 OR length(s) > 34 THEN 'account_number has invalid length' END, CASE WHEN regexp_matches(s, {ANY_SQL}) THEN 'account_number contains invalid characters' END) AS errors
FROM (SELECT c_custkey, regexp_replace({ACCOUNT}, '[\\s-]', '', 'g') AS s FROM customer)
""")
def _(i: Inputs):
    r = q.validate_account_number(F.expr(ACCOUNT))
    return i.table("customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.value", F.concat_ws("; ", "r.errors").alias("errors"))


@query("C25_suspicious_text", "doc_id bigint, sql_hit boolean, markup_hit boolean", f"""
SELECT doc_id, regexp_matches(text, {ANY_SQL}) AS sql_hit, regexp_matches(text, {ANY_MARKUP}) AS markup_hit FROM documents
""")
def _(i: Inputs):
    t = F.col("text")
    return i.table("documents").select("doc_id", q.has_sql_injection(t).alias("sql_hit"), q.has_markup(t).alias("markup_hit"))


@query("C25_matched_pattern", "page_id bigint, markup string", "SELECT page_id, coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(html, {lit('(?i)' + p)}) THEN regexp_extract(html, {lit('(?i)' + p)}, 0) END" for p in v.MARKUP_PATTERNS) + ") AS markup FROM pages")
def _(i: Inputs):
    return i.table("pages").select("page_id", q.markup_match(F.col("html")).alias("markup"))


AGENT = """CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Mozilla/5.0 Chrome/120 Safari/537' WHEN 1 THEN 'Firefox/121' WHEN 2 THEN 'Version/17 Safari/605'
 WHEN 3 THEN 'Chrome/120 Edge/18' ELSE 'curl/8' END"""


@query("C27_device", "event_id bigint, platform string, browser string", f"""
SELECT event_id, CASE WHEN p LIKE '%windows%' THEN 'windows' WHEN p LIKE '%mac%' OR p LIKE '%darwin%' THEN 'macos' WHEN p LIKE '%linux%' THEN 'linux' WHEN p LIKE '%android%' THEN 'android'
 WHEN p LIKE '%ios%' OR p LIKE '%iphone%' OR p LIKE '%ipad%' THEN 'ios' ELSE p END AS platform,
 CASE WHEN u LIKE '%chrome%' AND u NOT LIKE '%edge%' THEN 'chrome' WHEN u LIKE '%firefox%' THEN 'firefox' WHEN u LIKE '%safari%' AND u NOT LIKE '%chrome%' THEN 'safari' WHEN u LIKE '%edge%' THEN 'edge' ELSE 'other' END AS browser
FROM (SELECT event_id, lower(platform) AS p, lower({AGENT}) AS u FROM login_events)
""")
def _(i: Inputs):
    return i.login_events.select(
        "event_id", x.platform_family(F.col("platform")).alias("platform"), x.browser_family(F.expr(AGENT)).alias("browser")
    )


@query("C28_parsed_row", "line_no bigint, day string, description string, amount double", f"""
SELECT l.line_no, CAST(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y')) AS DATE) AS day, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, abs(a.amount) AS amount
FROM statement_lines l JOIN ({AMOUNT_SQL}) a USING (file, line_no)
""")
def _(i: Inputs):
    return i.statement_lines.select(
        "line_no", x.parsed_date(F.col("date_text")).alias("day"), x.squeeze(F.col("description")).alias("description"),
        F.abs(x.clean_amount(F.col("amount_text"))).alias("amount"),
    )


@query("C29_raw_record", "txn_id bigint, raw_data string", """
SELECT txn_id, CAST(json_object('txn_id', txn_id, 'date', CAST(CAST(transaction_date AS DATE) AS VARCHAR), 'description', description, 'amount', CAST(amount AS DOUBLE), 'transaction_type', transaction_type) AS VARCHAR) AS raw_data
FROM transactions
""")
def _(i: Inputs):
    from spendlake.sources.store import raw_record

    rows = i.transactions.select("txn_id", F.to_date("transaction_date").cast("string").alias("date"), "description", F.col("amount").cast("double").alias("amount"), "transaction_type")
    return rows.select("txn_id", raw_record(rows).alias("raw_data"))
