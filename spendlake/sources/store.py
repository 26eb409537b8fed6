"""Writing to the stored tables: validated inserts, updates, deletes, upload ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.quality import transaction_errors

# Transaction source by file extension.
SOURCE_OF_EXTENSION = {"pdf": "PDF", "csv": "CSV", "xlsx": "EXCEL", "xls": "EXCEL", "xlsm": "EXCEL"}


def source_of(extension: Column) -> Column:
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    mapping = F.create_map(*[F.lit(s) for pair in SOURCE_OF_EXTENSION.items() for s in pair])
    return F.coalesce(F.try_element_at(mapping, ext), F.lit("API"))


def raw_record(df: DataFrame) -> Column:
    """The row as JSON, for the raw_data column."""
    return F.to_json(F.struct(*df.columns))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the insert rules, and the others with their errors."""
    checked = transaction_errors(rows)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def insert_counts(rows: DataFrame) -> DataFrame:
    """Created, failed and duplicate counts of an insert."""
    ok = F.size("errors") == 0
    return transaction_errors(rows).agg(
        F.count(F.when(ok, 1)).alias("created_count"),
        F.count(F.when(~ok, 1)).alias("failed_count"),
        F.lit(0).alias("duplicate_count"),
    )


def append_transactions(rows: DataFrame, path: str) -> None:
    """Append valid rows, clustered by month so that period filters prune files."""
    with_month = rows.withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM"))
    with_month.write.mode("append").partitionBy("txn_month").parquet(path)


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Write rows to a new shared folder and read them back, cutting the lineage."""
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def apply_updates(txns: DataFrame, changes: DataFrame, now: dt.datetime, keys: tuple[str, ...] = ("txn_id",)) -> DataFrame:
    """Apply a change table: only its non-null fields are set.

    A changed category clears the automatic flag and score. Keys are unique in
    both tables.
    """
    fields = [c for c in changes.columns if c not in keys and c in txns.columns]
    patch = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = txns.join(patch, list(keys), "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    if "category_id" in fields:
        manual = F.col("_new_category_id").isNotNull()
        if "is_auto_categorized" in txns.columns:
            out = out.withColumn("is_auto_categorized", F.when(manual, F.lit(False)).otherwise(F.col("is_auto_categorized")))
        if "confidence_score" in txns.columns:
            out = out.withColumn("confidence_score", F.when(~manual, F.col("confidence_score")))
    if "updated_at" in txns.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at")))
    return out.select(*txns.columns)


def soft_delete(txns: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """Flag the listed rows of their owners; rows already deleted keep their time."""
    marked = ids.select("txn_id", "user_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("is_deleted")
    deleted_at = F.col("deleted_at") if "deleted_at" in txns.columns else F.lit(None).cast("timestamp")
    out = txns.join(marked, ["txn_id", "user_id"], "left").withColumn("_now", hit)
    return out.withColumn("deleted_at", F.when(F.col("_now"), F.lit(now)).otherwise(deleted_at)).withColumn(
        "is_deleted", F.col("is_deleted") | F.col("_now")
    ).drop("_hit", "_now")


def hard_delete(txns: DataFrame, ids: DataFrame) -> DataFrame:
    return txns.join(ids.select("txn_id", "user_id"), ["txn_id", "user_id"], "left_anti")


def recategorize(txns: DataFrame, corrections: DataFrame, now: dt.datetime) -> DataFrame:
    """Set the category a user chose; (txn_id, user_id, category_id)."""
    return apply_updates(txns, corrections, now, ("txn_id", "user_id"))


def delete_batch(txns: DataFrame, jobs: DataFrame) -> DataFrame:
    """Remove the rows of the listed upload jobs."""
    return txns.join(jobs.select(F.col("job_id").alias("upload_batch_id")), "upload_batch_id", "left_anti")


def upload_ledger(jobs: DataFrame, txns: DataFrame) -> DataFrame:
    """Upload jobs with the number of stored rows of each."""
    counts = (
        txns.filter(~F.col("is_deleted"))
        .groupBy(F.col("upload_batch_id").alias("job_id"))
        .agg(F.count(F.lit(1)).alias("transactions_count"))
    )
    return jobs.join(counts, "job_id", "left").withColumn(
        "transactions_count", F.coalesce("transactions_count", F.lit(0))
    )


def job_transactions(txns: DataFrame, job_id: str) -> DataFrame:
    rows = txns.filter((F.col("upload_batch_id") == job_id) & ~F.col("is_deleted"))
    return rows.orderBy(F.col("transaction_date").desc(), "txn_id")


def preview_import(parsed: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Flag parsed rows whose content key is stored already."""
    known = stored_keys.select("user_id", "key").distinct().withColumn("_known", F.lit(True))
    return parsed.join(known, ["user_id", "key"], "left").withColumn("is_duplicate", F.coalesce("_known", F.lit(False))).drop("_known")


def confirm_import(preview: DataFrame, selected: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Selected rows, with the category a user chose for some of them."""
    rows = preview.join(selected.select("temp_id"), "temp_id", "left_semi")
    if overrides is None:
        return rows
    chosen = overrides.select("temp_id", F.col("category_id").alias("_override"))
    return rows.join(chosen, "temp_id", "left").withColumn("category_id", F.coalesce("_override", "category_id")).drop("_override")
