"""Bank SMS, app notifications and short manual entries to transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions import text as x
from spendlake.functions.rules import first_group, first_regex, found

MONEY = r"(?:₹|\bRs\.?|\bINR)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
DATE = r"(?i)\bon\s+(\d{1,2}[-/](?:\d{1,2}|[A-Za-z]{3})[-/]\d{2,4})"
BALANCE = r"(?i)\b(?:Avl\s*Bal|Available\s*Balance|Bal)\.?\s*:?\s*(?:₹|Rs\.?|INR)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
MERCHANTS = [
    r"(?i)\bto\s+([A-Za-z][A-Za-z0-9 &.'-]*?)(?:\s+on\b|\s+via\b|\s+ref\b|[.,;]|$)",
    r"(?i)\bat\s+([A-Za-z][A-Za-z0-9 &.'-]*?)(?:\s+on\b|\s+via\b|\s+ref\b|[.,;]|$)",
    r"(?i)\bfrom\s+([A-Za-z][A-Za-z0-9 &.'-]*?)(?:\s+on\b|\s+via\b|\s+ref\b|[.,;]|$)",
]
MANUAL = r"^\s*(?:₹|(?i:Rs)\.?|INR)\s*[0-9][0-9,]*(?:\.[0-9]{1,2})?\s+(\D+?)\s*$"
BANKS = [("HDFC", "HDFC"), ("SBI", "SBI"), ("ICICI", "ICICI"), ("Axis", "AXIS"), ("Kotak", "KOTAK")]
APPS = [(r"Google\s*Pay|GPay", "gpay"), ("PhonePe", "phonepe"), ("Paytm", "paytm"), ("Navi", "navi"), ("BHIM", "bhim")]


def parse_messages(messages: DataFrame, as_of: dt.date) -> DataFrame:
    """(message_id, body) to amount, merchant, bank, app, day, direction and balance."""
    body = F.col("body")
    manual = found(body, MANUAL)
    direction = (
        F.when(body.rlike(r"(?i)\b(debited|spent|paid|sent|withdrawn|purchase)\b"), "DEBIT")
        .when(body.rlike(r"(?i)\b(credited|received|refund|deposited)\b"), "CREDIT")
        .when(manual.isNotNull(), "DEBIT")
        .otherwise("UNKNOWN")
    )
    return messages.select(
        "message_id",
        x.clean_amount(found(body, "(?i)" + MONEY)).cast("decimal(15,2)").alias("amount"),
        F.trim(F.coalesce(manual, first_group(body, MERCHANTS))).alias("merchant"),
        first_regex(body, BANKS).alias("bank"),
        first_regex(body, APPS).alias("app"),
        x.clean_date(found(body, DATE), as_of).alias("day"),
        direction.alias("transaction_type"),
        x.clean_amount(found(body, BALANCE)).cast("decimal(15,2)").alias("balance"),
        manual.isNotNull().alias("is_manual"),
    )
