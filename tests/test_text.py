"""Scalar functions on literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlake.functions import quality as q
from spendlake.functions import text as x

AS_OF = dt.date(2024, 6, 15)


def values(spark, fn, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    return [r[0] for r in df.select("k", fn(F.col("s")).alias("v")).orderBy("k").select("v").collect()]


@pytest.mark.parametrize("fn, cases", [
    (x.clean_amount, [
        ("₹1,234.56", 1234.56), ("(1,234.56)", -1234.56), ("1234.56 DR", -1234.56), ("INR 1234.56", 1234.56),
        ("Rs. 1,234.56", 1234.56), ("Rs.1,234.56", 1234.56), ("1,23,456.78", 123456.78), ("--", None), ("", None), ("n/a", None),
        ("-500", -500.0), ("1.234.56", 1.23456), ("5-3", None), (None, None), ("1234 CR", 1234.0),
    ]),
    (lambda c: x.clean_date(c, AS_OF).cast("string"), [
        ("2024-01-05", "2024-01-05"), ("05/01/2024", "2024-01-05"), ("5/1/2024", "2024-01-05"), ("05-01-2024", "2024-01-05"),
        ("2024/01/05", "2024-01-05"), ("01/25/2024", "2024-01-25"), ("05 Jan 2024", "2024-01-05"), ("05-JAN-2024", "2024-01-05"),
        ("05 jan 24", "2024-01-05"), ("05-Jan-95", "1995-01-05"), ("05/01/24", "2024-01-05"), ("05012024", "2024-01-05"),
        ("Jan 05, 2024", "2024-01-05"), ("January 05, 2024", "2024-01-05"), ("01/12/2024", "2024-01-12"),
        ("31/12/1980", None), ("n/a", None), ("05-02-24", "2024-02-05"), (None, None),
    ]),
    (x.clean_description, [("  a   b ", "a b"), ("UPI/123/SWIGGY@ybl", "UPI - SWIGGY (UPI/123/SWIGGY@ybl)"), (None, ""), ("a–b ’c", "a-b 'c")]),
    (x.extract_reference, [("UPI/12345/X", "12345"), ("IMPS-777", "777"), ("NEFT/AB12", "AB12"), ("TXN ID: Z9", "Z9"), ("none", None)]),
    (x.normalize_bank_name, [("hdfc bank ltd", "HDFC"), ("State Bank of India", "SBI"), (" village ", "VILLAGE"), ("", None)]),
    (x.mask_account_number, [("50100012345678", "XXXX-XXXX-5678"), ("12", "XXXX"), ("", "")]),
    (x.description_class, [("SWIGGY order", "Food & Dining"), ("service", "Utilities"), ("zzz", "Other"), ("", None)]),
    (x.extract_upi_id, [("pay SHOP@ybl now", "shop@ybl"), ("cash", None)]),
    (lambda c: x.merchant_name_guess(x.normalize_description(c)), [("to blue tokai via upi", "Blue Tokai"), ("Netflix monthly", "Netflix"), ("123", None)]),
    (x.slug, [("Clothes/Apparel", "clothesapparel"), ("Food & Dining", "food-dining"), ("  A_b ", "a-b")]),
    (x.mask_email, [("jo@x.com", "j***@x.com"), ("john@x.com", "j***n@x.com"), ("none", "none")]),
    (x.safe_uuid, [("{12345678-1234-1234-1234-123456789ABC}", "12345678-1234-1234-1234-123456789abc"), ("nope", None)]),
    (q.strip_html, [("<b>a &amp; b</b>", "a & b"), ("x &eacute;", "x é"), ("plain", "plain")]),
    (q.normalize_nfc, [("é", "é"), ("abc", "abc")]),
    (q.sanitize_filename, [("../a<b>.csv", "a_b_.csv"), ("x" * 300 + ".pdf", "x" * 200 + ".pdf")]),
    (q.has_sql_injection, [("1 OR 1=1", True), ('x OR "y"', True), ("hello", False), ("drop it", True), ("sleep (5)", True)]),
    (q.has_markup, [("<script>x</script>", True), ("onclick = 1", True), ("url (x)", True), ("&{x", True), ("plain text", False)]),
])
def test_values(spark, fn, cases):
    got = values(spark, fn, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_subscription_and_hints(spark):
    row = spark.range(1).select(
        F.size(x.amount_hints(F.lit(250), F.lit(True))).alias("debit"),
        x.amount_hints(F.lit(25000), F.lit(False))[0]["subcategory"].alias("credit"),
        F.size(x.amount_hints(F.lit(50), F.lit(False))).alias("none"),
    ).first()
    assert (row["debit"], row["credit"], row["none"]) == (4, "Salary", 0)
