"""Fixed schemas of the stored tables and of the parse job's output."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


TRANSACTION = _struct(
    ("txn_id", T.LongType()),
    ("user_id", T.LongType()),
    ("amount", MONEY),
    ("transaction_type", T.StringType()),
    ("category_id", T.IntegerType()),
    ("merchant_name", T.StringType()),
    ("merchant_category", T.StringType()),
    ("description", T.StringType()),
    ("notes", T.StringType()),
    ("transaction_date", T.TimestampType()),
    ("source", T.StringType()),
    ("bank_name", T.StringType()),
    ("account_last_4", T.StringType()),
    ("tags", T.ArrayType(T.StringType())),
    ("is_recurring", T.BooleanType()),
    ("recurring_pattern", T.StringType()),
    ("is_auto_categorized", T.BooleanType()),
    ("confidence_score", T.DoubleType()),
    ("upload_batch_id", T.StringType()),
    ("raw_data", T.StringType()),
    ("is_deleted", T.BooleanType()),
    ("deleted_at", T.TimestampType()),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

CATEGORY = _struct(
    ("category_id", T.IntegerType()),
    ("name", T.StringType()),
    ("slug", T.StringType()),
    ("parent_id", T.IntegerType()),
    ("is_income", T.BooleanType()),
    ("display_order", T.IntegerType()),
)

BUDGET = _struct(
    ("budget_id", T.LongType()),
    ("user_id", T.LongType()),
    ("category_id", T.IntegerType()),
    ("amount_limit", MONEY),
    ("period", T.StringType()),
    ("alert_threshold", T.DoubleType()),
)

PARSED_TRANSACTION = _struct(
    ("file", T.StringType()),
    ("line_no", T.LongType()),
    ("date", T.StringType()),
    ("description", T.StringType()),
    ("amount", T.DoubleType()),
    ("transaction_type", T.StringType()),
    ("balance", T.DoubleType()),
    ("reference", T.StringType()),
    ("raw_text", T.StringType()),
    ("confidence", T.DoubleType()),
    ("category", T.StringType()),
)

MERCHANT_KEYWORD = _struct(
    ("ord", T.IntegerType()),
    ("merchant", T.StringType()),
    ("keyword", T.StringType()),
    ("category", T.StringType()),
    ("subcategory", T.StringType()),
    ("confidence", T.DoubleType()),
    ("is_subscription", T.BooleanType()),
)
