"""Row predicates and projections over the transactions table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.money import period
from spendlake.functions.rules import any_of
from spendlake.operators.ranking import top_k


def active(df: DataFrame, user_id: int | str | None = None) -> DataFrame:
    """Rows that are not deleted, of all users or of one."""
    rows = df.filter(~F.col("is_deleted"))
    return rows if user_id is None else rows.filter(F.col("user_id") == F.lit(user_id))


def ilike_any(text: str, columns: Sequence[str]) -> Column:
    """Case-insensitive substring test; % and _ in the term are literal."""
    term = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return any_of(F.col(c).ilike(f"%{term}%") for c in columns)


@dataclass(frozen=True)
class TransactionFilter:
    """Optional conditions; only those that are set become predicates."""

    category_id: int | None = None
    category_ids: Sequence[int] | None = None
    transaction_type: str | None = None
    source: str | None = None
    is_recurring: bool | None = None
    start_date: dt.date | None = None
    end_date: dt.date | None = None
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    search: str | None = None
    merchant_name: str | None = None

    def __post_init__(self) -> None:
        if self.start_date and self.end_date and self.end_date < self.start_date:
            raise ValueError("end_date must not be before start_date")

    def conditions(self) -> list[Column]:
        out: list[Column] = []
        if self.category_id is not None:
            out.append(F.col("category_id") == self.category_id)
        if self.category_ids:
            out.append(F.col("category_id").isin(list(self.category_ids)))
        if self.transaction_type:
            out.append(F.col("transaction_type") == self.transaction_type)
        if self.source:
            out.append(F.col("source") == self.source)
        if self.is_recurring is not None:
            out.append(F.col("is_recurring") == self.is_recurring)
        if self.start_date:
            out.append(F.col("transaction_date") >= F.lit(self.start_date))
        if self.end_date:
            out.append(F.col("transaction_date") < F.lit(self.end_date + dt.timedelta(days=1)))
        if self.min_amount is not None:
            out.append(F.col("amount") >= F.lit(self.min_amount))
        if self.max_amount is not None:
            out.append(F.col("amount") <= F.lit(self.max_amount))
        if self.search:
            out.append(ilike_any(self.search, ["description", "merchant_name"]))
        if self.merchant_name:
            out.append(ilike_any(self.merchant_name, ["merchant_name"]))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for condition in self.conditions():
            df = df.filter(condition)
        return df


SORT_COLUMNS = ("transaction_date", "amount", "created_at")


def sort_transactions(df: DataFrame, sort_by: str = "transaction_date", sort_order: str = "desc") -> DataFrame:
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
    c = F.col(sort_by)
    return df.orderBy(c.asc() if sort_order == "asc" else c.desc(), F.col("txn_id"))


def search_transactions(df: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Newest ``limit`` hits of every user in description, merchant or notes."""
    hits = active(df).filter(ilike_any(query, ["description", "merchant_name", "notes"]))
    return top_k(hits, ["user_id"], [F.col("transaction_date").desc(), F.col("txn_id").desc()], limit)


def get_transaction(df: DataFrame, txn_id: int, user_id: int) -> DataFrame:
    return active(df, user_id).filter(F.col("txn_id") == txn_id)


def visible_categories(categories: DataFrame, user_id: int | str) -> DataFrame:
    """The user's own categories and the system ones."""
    return categories.filter((F.col("user_id") == F.lit(user_id)) | F.col("is_system"))


def visible_category_counts(categories: DataFrame, users: DataFrame) -> DataFrame:
    """For every user, how many categories can be chosen from (own + system).

    System categories are counted once, not joined to each user.
    """
    system = categories.filter("is_system").agg(F.count(F.lit(1)).alias("system_count"))
    own = (
        categories.filter(~F.col("is_system"))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("own_count"))
    )
    n_system = F.lit(system.first()["system_count"])
    return users.join(own, "user_id", "left").select(
        "user_id", (F.coalesce("own_count", F.lit(0)) + n_system).alias("category_count")
    )


def transaction_view(df: DataFrame, categories: DataFrame) -> DataFrame:
    """The response shape: nested category, tags never null."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    c = categories.select(
        F.col("category_id"), F.struct(F.col("category_id").alias("id"), F.col("name")).alias("category")
    )
    keep = [x for x in df.columns if x not in ("tags", "is_deleted")]
    return active(df).join(c, "category_id", "left").select(*keep, "category", tags.alias("tags"))


def in_period(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return df.filter(period(start, end))
