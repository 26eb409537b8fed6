"""Dictionary matching, retrieval, classification and the whole categorisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions import text as x
from spendlake.operators import categorize as c
from spendlake.operators import classifier, matching
from spendlake.plans.registry import Inputs, query
from spendlake.plans.text import BEST_CONTAINED, GUESS, NORMALIZED, first_of, lit
from spendlake.session import checkpoint_dir
from spendlake.operators.analytics import CATEGORY_ALIASES
from spendlake.sources import dimensions as dim


def _upi_patterns(i: Inputs):
    return i.merchant_keywords.select("ord", "merchant", F.replace("keyword", F.lit(" "), F.lit("")).alias("pattern"), "category", "subcategory")


def contains_sql(source: str, text: str) -> str:
    return f"""SELECT txn_id, merchant, category, subcategory, min(ord) AS ord,
 first(least(0.95, confidence * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (length(keyword) / length({text})))) ORDER BY ord) AS confidence
FROM ({source}) s JOIN merchant_keywords k ON contains(lower({text}), k.keyword) GROUP BY 1, 2, 3, 4"""


EXACT = f"SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY confidence DESC, ord) AS rank FROM ({contains_sql(NORMALIZED, 'normalized')})"
MATCH_COLUMNS = "txn_id bigint, merchant string, category string, subcategory string, confidence double, rank bigint"


@query("J9_contained_keywords", MATCH_COLUMNS, EXACT)
def _(i: Inputs):
    rows = i.transactions.withColumn("normalized", x.normalize_description(F.col("description")))
    return matching.best_contained(rows, "txn_id", "normalized", i.merchant_keywords, None)


UPI = f"""
SELECT txn_id, first(merchant ORDER BY ord) AS merchant, first(category ORDER BY ord) AS category, first(subcategory ORDER BY ord) AS subcategory
FROM (SELECT txn_id, split_part({first_of('lower(description)', v.UPI_ID_PATTERNS)}, '@', 1) AS handle FROM transactions) u
JOIN (SELECT ord, merchant, category, subcategory, replace(keyword, ' ', '') AS pattern FROM merchant_keywords) p ON contains(handle, pattern) GROUP BY txn_id
"""


@query("J10_upi_handle", "txn_id bigint, merchant string, category string, subcategory string", UPI)
def _(i: Inputs):
    rows = i.transactions.select("txn_id", x.extract_upi_id(F.col("description")).alias("upi"))
    return matching.upi_matches(rows, "txn_id", "upi", _upi_patterns(i))


TYPO = "CASE CAST(txn_id % 5 AS INT) WHEN 0 THEN 'swigy' WHEN 1 THEN 'amazn' WHEN 2 THEN 'netflixx' WHEN 3 THEN 'blue toki' ELSE lower(merchant_name) END"


def fuzzy_sql(source: str, threshold: float, k: int) -> str:
    return f"""SELECT txn_id, merchant, category, subcategory, score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY score DESC, ord) AS rank FROM (
 SELECT txn_id, merchant, category, subcategory, min(ord) AS ord, first(sim * confidence ORDER BY ord) AS score FROM (
  SELECT s.txn_id, m.*, CASE WHEN abs(length(s.t) - length(keyword)) > greatest(length(s.t), length(keyword)) * 0.5 THEN 0
   ELSE 1 - CAST(levenshtein(s.t, keyword) AS DOUBLE) / greatest(length(s.t), length(keyword)) END AS sim
  FROM ({source}) s, merchant_keywords m WHERE length(s.t) > 0) WHERE sim >= {threshold} GROUP BY 1, 2, 3, 4)) WHERE rank <= {k}"""


@query("J11_fuzzy_keywords", "txn_id bigint, merchant string, category string, subcategory string, score double, rank bigint",
       fuzzy_sql(f"SELECT txn_id, {TYPO} AS t FROM transactions", 0.7, 5))
def _(i: Inputs):
    return matching.fuzzy_matches(i.transactions.select("txn_id", F.expr(TYPO).alias("t")), "txn_id", "t", i.merchant_keywords)


def narration(field: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(description, {lit('(?i)' + r[0])}) THEN {lit(r[field])}" for r in v.BANK_NARRATIONS) + " END"


@query("J12_bank_narration", "txn_id bigint, category string, subcategory string",
       f"SELECT txn_id, {narration(1)} AS category, {narration(2)} AS subcategory FROM transactions")
def _(i: Inputs):
    b = c.bank_narration(F.col("description"))
    return i.transactions.select("txn_id", b["category"].alias("category"), b["subcategory"].alias("subcategory"))


RANGES = ", ".join(f"({n}, {lo}, {hi}, {lit(cat)}, {lit(sub)}, CAST({p} AS DOUBLE))" for n, (lo, hi, cat, sub, p) in enumerate(v.AMOUNT_RANGES))


def amount_sql(source: str, k: int) -> str:
    return f"""SELECT txn_id, cat AS category, sub AS subcategory, conf AS confidence, rank FROM (
 SELECT txn_id, cat, sub, conf, row_number() OVER (PARTITION BY txn_id ORDER BY conf DESC, o) AS rank FROM ({source}) s, (VALUES {RANGES}) r(o, lo, hi, cat, sub, conf)
 WHERE transaction_type = 'DEBIT' AND amount BETWEEN lo AND hi
 UNION ALL SELECT txn_id, 'Income', 'Salary', CAST(0.5 AS DOUBLE), 1 FROM ({source}) s WHERE transaction_type <> 'DEBIT' AND amount >= 20000
 UNION ALL SELECT txn_id, 'Income', sub, conf, o FROM ({source}) s, (VALUES (1, 'Other Income', CAST(0.30 AS DOUBLE)), (2, 'Refund', CAST(0.25 AS DOUBLE)), (3, 'Cashback', CAST(0.20 AS DOUBLE))) r(o, sub, conf)
 WHERE transaction_type <> 'DEBIT' AND amount >= 100 AND amount < 20000) WHERE rank <= {k}"""


SPREAD = "CASE WHEN txn_id % 2 = 0 THEN CAST(amount % 2000 AS DECIMAL(15,2)) ELSE amount END"


@query("J13_amount_ranges", "txn_id bigint, category string, subcategory string, confidence double, rank bigint",
       amount_sql(f"SELECT txn_id, transaction_type, {SPREAD} AS amount FROM transactions", 5))
def _(i: Inputs):
    hints = x.amount_hints(F.expr(SPREAD), F.col("transaction_type") == "DEBIT")
    return i.transactions.select("txn_id", F.posexplode(hints).alias("pos", "h")).select("txn_id", "h.*", (F.col("pos") + 1).alias("rank"))


CORRECTIONS = """SELECT description, amount, CASE WHEN txn_id % 2 = 0 THEN 'Shopping' ELSE 'Travel' END AS category, 'Fixed ' || CAST(txn_id % 3 AS VARCHAR) AS subcategory,
 transaction_date AS corrected_at, txn_id FROM transactions WHERE txn_id % 7 = 0"""
LATEST = f"""SELECT normalized, amount, first(category ORDER BY corrected_at DESC, k DESC) AS category, first(subcategory ORDER BY corrected_at DESC, k DESC) AS subcategory
FROM (SELECT n.normalized, x.amount, x.category, x.subcategory, x.corrected_at, x.txn_id AS k FROM ({CORRECTIONS}) x JOIN ({NORMALIZED}) n ON n.txn_id = x.txn_id) GROUP BY 1, 2"""


def _corrections(i: Inputs):
    return i.transactions.filter("txn_id % 7 = 0").select(
        "description", "amount", F.expr("CASE WHEN txn_id % 2 = 0 THEN 'Shopping' ELSE 'Travel' END").alias("category"),
        F.concat(F.lit("Fixed "), (F.col("txn_id") % 3).cast("string")).alias("subcategory"),
        F.struct("transaction_date", "txn_id").alias("corrected_at"),
    )


@query("J14_user_corrections", "txn_id bigint, category string, subcategory string", f"""
SELECT n.txn_id, l.category, l.subcategory FROM ({NORMALIZED}) n JOIN transactions t ON t.txn_id = n.txn_id
LEFT JOIN ({LATEST}) l ON l.normalized = n.normalized AND l.amount = t.amount
""")
def _(i: Inputs):
    rows = i.transactions.withColumn("normalized", x.normalize_description(F.col("description")))
    return rows.join(c.latest_corrections(_corrections(i)), ["normalized", "amount"], "left").select("txn_id", "c.category", "c.subcategory")


@query("M11_corrections_log", "normalized string, amount double, category string, subcategory string", LATEST)
def _(i: Inputs):
    path = f"{checkpoint_dir(i.spark)}/corrections-{uuid.uuid4().hex}"
    c.record_corrections(path, _corrections(i))
    return c.latest_corrections(i.spark.read.parquet(path)).select("normalized", "amount", "c.category", "c.subcategory")


# --- TF-IDF ------------------------------------------------------------------------------


def terms_sql(source: str, key: str, text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"""SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
 FROM (SELECT {key}, {words} AS w FROM ({source}))"""


def index_sql(source: str, key: str, text: str) -> str:
    return f"""WITH tf AS (SELECT {key}, term, count(*) AS tf FROM ({terms_sql(source, key, text)}) GROUP BY 1, 2),
 idf AS (SELECT term, ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM ({source}))) / (CAST(1 AS DOUBLE) + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 w AS (SELECT {key}, tf.term, idf, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
 n AS (SELECT {key} AS nk, sqrt(CAST(sum(CAST(w * w AS DECIMAL(28,12))) AS DOUBLE)) AS norm FROM w GROUP BY 1)
SELECT {key}, term, idf, w / norm AS weight FROM w JOIN n ON nk = {key}"""


@query("M1_tfidf_index", "doc bigint, term string, idf double, weight double", f"""
SELECT doc, term, round(idf, 9) AS idf, round(weight, 9) AS weight FROM ({index_sql("SELECT conv_id * 1000 + turn AS doc, text FROM conversations", "doc", "text")})
""")
def _(i: Inputs):
    docs = i.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    index = matching.tfidf_index(docs, "doc", "text")
    return index.select("doc", "term", F.round("idf", 9).alias("idf"), F.round("weight", 9).alias("weight"))


DOCS = """SELECT merchant, concat_ws(' ', merchant, string_agg(keyword, ' ' ORDER BY ord), category, subcategory) AS text FROM merchant_keywords GROUP BY merchant, category, subcategory"""


def retrieve_sql(queries: str, k: int | None, min_score: float) -> str:
    return f"""SELECT txn_id, merchant, score, rank FROM (
SELECT txn_id, merchant, score, row_number() OVER (PARTITION BY txn_id ORDER BY score DESC, merchant) AS rank FROM (
WITH ix AS ({index_sql(DOCS, 'merchant', 'text')}),
 q AS (SELECT txn_id, t.term, count(*) * d.idf AS w FROM ({terms_sql(queries, 'txn_id', 'query')}) t JOIN (SELECT DISTINCT term, idf FROM ix) d ON d.term = t.term GROUP BY txn_id, t.term, d.idf),
 qn AS (SELECT txn_id AS nk, sqrt(CAST(sum(CAST(w * w AS DECIMAL(28,12))) AS DOUBLE)) AS norm FROM q GROUP BY 1)
SELECT txn_id, merchant, round(CAST(sum(CAST(w * weight AS DECIMAL(28,12))) AS DOUBLE) / max(norm), 9) AS score FROM q JOIN ix ON ix.term = q.term JOIN qn ON nk = txn_id GROUP BY 1, 2
) WHERE score > 0 AND score >= {min_score}){f" WHERE rank <= {k}" if k else ""}"""


PLAIN = "SELECT txn_id, description || ' ' || coalesce(merchant_name, '') AS query FROM transactions"


def _plain(i: Inputs):
    return i.transactions.select("txn_id", F.concat_ws(" ", "description", F.coalesce("merchant_name", F.lit(""))).alias("query"))


@query("J16_tfidf_scores", "txn_id bigint, merchant string, score double", f"SELECT txn_id, merchant, score FROM ({retrieve_sql(PLAIN, None, 0)})")
def _(i: Inputs):
    index = c.retrieval_index(i.merchant_keywords)
    return matching.tfidf_retrieve(_plain(i), "txn_id", "query", index, "merchant", None)


@query("M2_tfidf_top_k", "txn_id bigint, merchant string, score double, rank bigint", retrieve_sql(PLAIN, 2, 0))
def _(i: Inputs):
    index = c.retrieval_index(i.merchant_keywords)
    return matching.tfidf_retrieve(_plain(i), "txn_id", "query", index, "merchant", 2)


@query("M3_retrieval_candidates", "txn_id bigint, merchant string, confidence double",
       f"SELECT txn_id, merchant, least(CAST(1 AS DOUBLE), score * CAST(1.15 AS DOUBLE)) AS confidence FROM ({retrieve_sql(PLAIN, 5, 0.2)})")
def _(i: Inputs):
    return c.retrieval_candidates(_plain(i), "txn_id", "query", i.merchant_keywords)


SUB_ROWS = ", ".join(f"({k * 100 + n}, {lit(c)}, {lit(s)})" for k, (c, subs) in enumerate(dim.SUBCATEGORIES.items()) for n, s in enumerate(subs))
WORD_ROWS = ", ".join(f"({k}, {lit(c)}, {lit(dim.SUBCATEGORIES[c][0])}, {lit(w)})" for k, (c, words) in enumerate(dim.CATEGORY_KEYWORDS.items()) for w in words)


@query("J17_infer_from_text", "conv_id bigint, turn bigint, category string, subcategory string, confidence double", f"""
WITH t AS (SELECT conv_id, turn, lower(text) AS s FROM conversations),
 a AS (SELECT conv_id, turn, first(cat ORDER BY o) AS cat, first(sub ORDER BY o) AS sub FROM t JOIN (VALUES {SUB_ROWS}) v(o, cat, sub) ON contains(s, lower(sub)) GROUP BY 1, 2),
 b AS (SELECT conv_id, turn, first(cat ORDER BY n DESC, o) AS cat, first(sub ORDER BY n DESC, o) AS sub, max(n) AS n FROM (
  SELECT conv_id, turn, o, cat, sub, count(*) AS n FROM t JOIN (VALUES {WORD_ROWS}) v(o, cat, sub, w) ON contains(s, w) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2)
SELECT t.conv_id, t.turn, coalesce(a.cat, b.cat) AS category, coalesce(a.sub, b.sub) AS subcategory,
 CASE WHEN a.cat IS NOT NULL THEN CAST(0.8 AS DOUBLE) WHEN b.cat IS NOT NULL THEN least(CAST(0.85 AS DOUBLE), CAST(0.6 AS DOUBLE) + b.n * CAST(0.05 AS DOUBLE)) END AS confidence
FROM t LEFT JOIN a ON a.conv_id = t.conv_id AND a.turn = t.turn LEFT JOIN b ON b.conv_id = t.conv_id AND b.turn = t.turn
""")
def _(i: Inputs):
    r = c.infer_from_text(F.col("text"))
    return i.table("conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


# --- classifier ----------------------------------------------------------------------------


def _training_rows(i: Inputs):
    from spendlake.operators.analytics import label_categories

    rows = label_categories(i.transactions, i.categories).filter("category_id IS NOT NULL")
    # Descriptions that say something about the label.
    return rows.withColumn("description", F.concat_ws(" ", "description", F.lower("subcategory")))


@query("M4_train_classifier", "txn_id bigint, category string, subcategory string, confidence double")
def _(i: Inputs):
    rows = _training_rows(i)
    return classifier.predict(classifier.train(rows), rows.select("txn_id", "description"))


@query("M5_predict_top_n", "txn_id bigint, category string, subcategory string, confidence double, rank bigint")
def _(i: Inputs):
    rows = _training_rows(i)
    return classifier.predict_top_n(classifier.train(rows), rows.select("txn_id", "description"), 3)


@query("M6_saved_classifier", "txn_id bigint, category string, subcategory string, confidence double")
def _(i: Inputs):
    rows = _training_rows(i)
    path = f"{checkpoint_dir(i.spark)}/classifier-{uuid.uuid4().hex}"
    classifier.save(classifier.train(rows), path)
    return classifier.predict(classifier.load(path), rows.select("txn_id", "description"))


# --- all stages ------------------------------------------------------------------------------

TIME_ROWS = [
    ("isodow(transaction_date) >= 6", "Food & Dining", "Restaurants", 0.1), ("isodow(transaction_date) >= 6", "Entertainment", "Movies/Cinema", 0.1),
    ("isodow(transaction_date) >= 6", "Shopping", "Clothes/Apparel", 0.05),
    ("hour(transaction_date) BETWEEN 6 AND 11", "Food & Dining", "Coffee/Tea", 0.1), ("hour(transaction_date) BETWEEN 6 AND 11", "Transport", "Cab/Auto", 0.1),
    ("hour(transaction_date) BETWEEN 17 AND 20", "Food & Dining", "Food Delivery", 0.1), ("hour(transaction_date) BETWEEN 17 AND 20", "Food & Dining", "Restaurants", 0.1),
    ("day(transaction_date) <= 5", "Housing", "Rent", 0.15), ("day(transaction_date) <= 5", "Income", "Salary", 0.15),
    ("day(transaction_date) >= 25", "Financial", "EMI Payment", 0.1), ("day(transaction_date) >= 25", "Financial", "Credit Card Bill", 0.1),
]
TIME = "\nUNION ALL ".join(
    f"SELECT txn_id, {lit(cat)} AS category, {lit(sub)} AS subcategory, CAST({p} AS DOUBLE) AS confidence, {n} AS pos FROM transactions WHERE {cond}"
    for n, (cond, cat, sub, p) in enumerate(TIME_ROWS))
RAG_QUERY = f"""SELECT n.txn_id, trim(concat_ws(' ', coalesce(b.merchant, {GUESS}), n.description)) AS query FROM ({NORMALIZED}) n LEFT JOIN ({BEST_CONTAINED}) b ON b.txn_id = n.txn_id"""
FACTS = "(SELECT DISTINCT merchant AS fm, category AS fc, subcategory AS fs FROM merchant_keywords)"
CANDIDATES = f"""
SELECT txn_id, category, subcategory, CAST(0.8 AS DOUBLE) AS confidence, 'pattern_match' AS method, NULL AS merchant, CAST(0.95 AS DOUBLE) AS weight, 0 AS stage, 0 AS pos
 FROM (SELECT txn_id, {narration(1)} AS category, {narration(2)} AS subcategory FROM transactions) WHERE category IS NOT NULL
UNION ALL SELECT n.txn_id, l.category, l.subcategory, CAST(0.99 AS DOUBLE), 'user_correction', NULL, CAST(1 AS DOUBLE), 1, 0
 FROM ({NORMALIZED}) n JOIN transactions t ON t.txn_id = n.txn_id JOIN ({LATEST}) l ON l.normalized = n.normalized AND l.amount = t.amount
UNION ALL SELECT txn_id, category, subcategory, CAST(0.9 AS DOUBLE), 'upi_match', merchant, CAST(0.98 AS DOUBLE), 2, 0 FROM ({UPI})
UNION ALL SELECT txn_id, category, subcategory, confidence, 'exact_match', merchant, CAST(1 AS DOUBLE), 3, rank FROM ({EXACT}) WHERE rank <= 3
UNION ALL SELECT txn_id, category, subcategory, score * CAST(0.8 AS DOUBLE), 'fuzzy_match', merchant, CAST(0.85 AS DOUBLE), 4, rank
 FROM ({fuzzy_sql(f"SELECT txn_id, normalized AS t FROM ({NORMALIZED}) WHERE txn_id NOT IN (SELECT txn_id FROM ({EXACT}))", 0.65, 2)})
UNION ALL SELECT txn_id, fc, fs, least(CAST(1 AS DOUBLE), score * CAST(1.15 AS DOUBLE)), 'rag_retrieval', merchant, CAST(0.92 AS DOUBLE), 6, rank
 FROM ({retrieve_sql(RAG_QUERY, 3, 0.2)}) JOIN {FACTS} ON fm = merchant
UNION ALL SELECT txn_id, category, subcategory, confidence, 'amount_heuristic', NULL, CAST(0.6 AS DOUBLE), 7, rank FROM ({amount_sql("SELECT * FROM transactions", 2)})
UNION ALL SELECT txn_id, category, subcategory, confidence, 'time_pattern', NULL, CAST(0.55 AS DOUBLE), 8, pos FROM ({TIME})
"""
RANKED = f"SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY confidence * weight DESC, stage, pos) AS rk FROM ({CANDIDATES})"
M7 = f"""
SELECT t.txn_id, coalesce(r.category, CASE WHEN t.transaction_type = 'DEBIT' THEN 'Personal' ELSE 'Income' END) AS category,
 coalesce(r.subcategory, CASE WHEN t.transaction_type = 'DEBIT' THEN 'Miscellaneous' ELSE 'Other Income' END) AS subcategory,
 coalesce(r.confidence, CAST(0.1 AS DOUBLE)) AS confidence, coalesce(r.method, 'default') AS method,
 CASE WHEN r.txn_id IS NOT NULL THEN coalesce(r.merchant, b.merchant, g.guess) END AS matched_merchant,
 r.txn_id IS NOT NULL AND coalesce(contains(lower(coalesce(r.merchant, b.merchant, g.guess)), 'netflix'), false) AS is_subscription
FROM transactions t LEFT JOIN (SELECT * FROM ({RANKED}) WHERE rk = 1) r ON r.txn_id = t.txn_id
LEFT JOIN ({BEST_CONTAINED}) b ON b.txn_id = t.txn_id LEFT JOIN (SELECT txn_id, {GUESS} AS guess FROM ({NORMALIZED})) g ON g.txn_id = t.txn_id
"""
M7_COLUMNS = "txn_id bigint, category string, subcategory string, confidence double, method string, matched_merchant string, is_subscription boolean"


def _categorized(i: Inputs, **options):
    return c.categorize(i.transactions, i.merchant_keywords, _upi_patterns(i), corrections=_corrections(i), **options)


@query("M7_categorize", M7_COLUMNS, M7)
def _(i: Inputs):
    return _categorized(i)


@query("M8_categorize_with_model", M7_COLUMNS)
def _(i: Inputs):
    model = classifier.train(_training_rows(i))
    return _categorized(i, predictions=classifier.predict(model, i.transactions.select("txn_id", "description")))


@query("U2_candidates", "txn_id bigint, n bigint, total double",
       f"SELECT txn_id, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(18,9))) AS DOUBLE) AS total FROM ({RANKED}) WHERE rk <= 5 AND (rk = 1 OR confidence >= 0.1) GROUP BY 1")
def _(i: Inputs):
    rows = _categorized(i).filter("method <> 'default'")
    alternatives = F.aggregate("alternatives", F.lit(0).cast("decimal(28,9)"), lambda s, a: (s + a["confidence"].cast("decimal(18,9)")).cast("decimal(28,9)"))
    return rows.select("txn_id", (F.size("alternatives") + 1).alias("n"), (F.col("confidence").cast("decimal(18,9)") + alternatives).alias("total"))


@query("W6_alternatives", "txn_id bigint, pos bigint, category string, subcategory string, confidence double",
       f"SELECT txn_id, row_number() OVER (PARTITION BY txn_id ORDER BY rk) AS pos, category, subcategory, confidence FROM ({RANKED}) WHERE rk BETWEEN 2 AND 5 AND confidence >= 0.1")
def _(i: Inputs):
    rows = _categorized(i).select("txn_id", F.posexplode("alternatives").alias("p", "a"))
    return rows.select("txn_id", (F.col("p") + 1).alias("pos"), "a.category", "a.subcategory", "a.confidence")


SUGGEST = f"""
SELECT txn_id, category, subcategory, confidence, rank FROM (
SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY rk) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY txn_id, category, subcategory ORDER BY rk) AS d FROM (
 SELECT txn_id, category, subcategory, confidence, rk FROM ({RANKED}) WHERE rk = 1 OR (rk <= 5 AND confidence >= 0.1)
 UNION ALL SELECT txn_id, category, subcategory, confidence, 1 FROM ({M7}) WHERE method = 'default')) WHERE d = 1) WHERE rank <= {{k}}
"""
SUGGEST_COLUMNS = "txn_id bigint, category string, subcategory string, confidence double, rank bigint"


@query("M10_suggestions", SUGGEST_COLUMNS, SUGGEST.replace("{k}", "3"))
def _(i: Inputs):
    return c.suggestions(_categorized(i), 3)


@query("U4_distinct_suggestions", SUGGEST_COLUMNS, SUGGEST.replace("{k}", "5"))
def _(i: Inputs):
    return c.suggestions(_categorized(i), 5)


NAMES = """SELECT txn_id, CASE CAST(txn_id % 6 AS INT) WHEN 0 THEN 'Food' WHEN 1 THEN 'Transport' WHEN 2 THEN 'Food & Dining' WHEN 3 THEN 'Nothing' WHEN 4 THEN 'Utilities' ELSE 'Income' END AS category,
 CASE CAST(txn_id % 5 AS INT) WHEN 0 THEN 'Coffee/Tea' WHEN 1 THEN 'Fuel' WHEN 2 THEN 'cab/auto' WHEN 3 THEN 'Unknown' ELSE 'RENT' END AS subcategory FROM transactions"""


@query("J8_resolve_category", "txn_id bigint, resolved_id bigint", f"""
WITH k AS (SELECT key, max(category_id) AS id FROM (
  SELECT category_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS key FROM categories
  UNION ALL SELECT category_id, lower(name) FROM categories) GROUP BY 1),
 n AS (SELECT *, CASE lower(category) WHEN 'food' THEN 'food-dining' WHEN 'food & dining' THEN 'food-dining' ELSE lower(category) END AS ck,
  CASE lower(subcategory) WHEN 'fuel' THEN 'petrol' ELSE regexp_replace(lower(subcategory), '/', '') END AS sk FROM ({NAMES}))
SELECT txn_id, coalesce(a.id, b.id, d.id, e.id) AS resolved_id FROM n LEFT JOIN k a ON a.key = sk LEFT JOIN k b ON b.key = lower(subcategory) LEFT JOIN k d ON d.key = ck LEFT JOIN k e ON e.key = lower(category)
""")
def _(i: Inputs):
    names = i.spark.sql(NAMES.replace("FROM transactions", "FROM {t}"), t=i.transactions)
    return c.resolve_category(names, i.categories)


UNCORRECTED = "\nUNION ALL ".join(leg for leg in CANDIDATES.split("\nUNION ALL ") if "'user_correction'" not in leg)


def slug_sql(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({name}), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"


def alias_sql(name: str) -> str:
    cases = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in CATEGORY_ALIASES.items())
    return f"CASE {slug_sql(name)} {cases} ELSE {slug_sql(name)} END"


def auto_sql(source: str) -> str:
    """Rows of ``source`` with category_id, is_auto_categorized, confidence_score: all stages, resolution, keyword fallback."""
    return f"""
WITH plain_rows AS ({source}),
 found AS (SELECT * FROM (
  WITH transactions AS (SELECT * REPLACE (trim(concat_ws(' ', description, coalesce(merchant_name, ''))) AS description) FROM plain_rows)
  {M7.replace(CANDIDATES, UNCORRECTED)})),
 k AS (SELECT key, max(category_id) AS id FROM (SELECT category_id, {slug_sql("name")} AS key FROM categories UNION ALL SELECT category_id, lower(name) FROM categories) GROUP BY 1),
 w AS (SELECT r.txn_id, first(c.category_id ORDER BY c.category_id) AS id FROM plain_rows r JOIN categories c
  ON c.parent_id IS NOT NULL AND contains(lower(concat_ws(' ', r.description, coalesce(r.merchant_name, ''))), lower(c.name)) GROUP BY 1),
 r AS (SELECT f.txn_id, f.confidence, coalesce(k1.id, k2.id, k3.id, k4.id) AS id FROM found f LEFT JOIN k k1 ON k1.key = {alias_sql("f.subcategory")}
  LEFT JOIN k k2 ON k2.key = lower(f.subcategory) LEFT JOIN k k3 ON k3.key = {alias_sql("f.category")} LEFT JOIN k k4 ON k4.key = lower(f.category))
SELECT p.* EXCLUDE (category_id), coalesce(p.category_id, r.id, w.id) AS category_id, p.category_id IS NULL AND coalesce(r.id, w.id) IS NOT NULL AS is_auto_categorized,
 CASE WHEN p.category_id IS NULL AND coalesce(r.id, w.id) IS NOT NULL THEN CASE WHEN r.id IS NULL THEN CAST(0.9 AS DOUBLE) ELSE r.confidence END END AS confidence_score
FROM plain_rows p LEFT JOIN r ON r.txn_id = p.txn_id LEFT JOIN w ON w.txn_id = p.txn_id"""


AUTO_COLUMNS = "txn_id bigint, category_id bigint, is_auto_categorized boolean, confidence_score double"


def auto_categorized(i: Inputs, rows):
    """The whole categorisation of an upload: every stage, then the names of the categories as keywords."""
    words = i.categories.filter("parent_id IS NOT NULL").select(F.col("category_id").alias("ord"), F.lower("name").alias("keyword"), "category_id")
    return c.auto_categorize(rows, i.categories, i.merchant_keywords, _upi_patterns(i), words)


@query("M9_auto_category", AUTO_COLUMNS, auto_sql("SELECT * FROM transactions"))
def _(i: Inputs):
    return auto_categorized(i, i.transactions)
