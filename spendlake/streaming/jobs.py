"""Structured Streaming jobs: ingest, dedup, limits, lockout, live spending.

Event time has a watermark (one day by default); rows that come later are left
to the batch tables. Jobs run with ``availableNow`` unless told otherwise.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spendlake.functions.text import transaction_key
from spendlake.session import checkpoint_dir
from spendlake.sources import delimited
from spendlake.streaming.audit import FRESH, OUTCOME, LockoutPolicy, advance

LATE = "1 day"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTED, PARTS_A_TASK = 8, 32  # tasks per core for listing and reading; parts of small files in a task beyond that


def start(
    df: DataFrame,
    checkpoint: str,
    path: str | None = None,
    mode: str = "append",
    each_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query to a parquet folder, or to a function per micro-batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", path).start()


def with_event_time(df: DataFrame, ts: str, late: str = LATE) -> DataFrame:
    """Event time as TIMESTAMP (a watermark refuses the zoneless type)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def statement_files(spark: SparkSession, folder: str) -> DataFrame:
    """New statement files of a folder as (file, line_no, line)."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    lines = F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    return files.select(F.col("_metadata.file_path").alias("file"), lines).withColumn("line", F.regexp_replace("line", "\r$", ""))


def ingest_statements(
    spark: SparkSession, folder: str, table: str, checkpoint: str, as_of: dt.date, finish: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Parse new files, apply ``finish`` (categorisation), append to the table.

    A batch writes to its own folder, so a repeated batch replaces itself. Its lines are read
    twice, for the facts about the files and for the rows: they are stored, so that every file is opened once.
    """
    lines = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    # One task for each folder costs more than the listing itself.
    spark.conf.set(LISTING, min(int(spark.conf.get(LISTING)), LISTED * spark.sparkContext.defaultParallelism))

    def each(batch: DataFrame, batch_id: int) -> None:
        # Spark counts 4 MB for opening a file: small files come as a few in each of very many parts.
        parts = batch.rdd.getNumPartitions()
        wanted = max(LISTED * spark.sparkContext.defaultParallelism, parts // PARTS_A_TASK)
        (batch.coalesce(wanted) if wanted < parts else batch).write.mode("overwrite").parquet(lines)
        parsed = delimited.parse_lines(spark.read.parquet(lines), as_of)
        rows = finish(parsed) if finish else parsed
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return start(statement_files(spark, folder), checkpoint, each_batch=each)


def deduplicated(transactions: DataFrame, late: str = LATE) -> DataFrame:
    """First row per content key within the watermark; state is bounded by it."""
    key = transaction_key(F.to_date("transaction_date"), F.col("amount"), F.col("transaction_type"), F.col("description"))
    return with_event_time(transactions, "transaction_date", late).withColumn("key", key).dropDuplicatesWithinWatermark(["user_id", "key"])


def request_counts(events: DataFrame, seconds: int = 60, slide: int = 10, late: str = LATE) -> DataFrame:
    """Requests per key in sliding windows."""
    w = F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w")
    return (
        with_event_time(events, "ts", late).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("window_start"), "user_id", "requests")
    )


def session_counts(sessions: DataFrame, late: str = LATE) -> DataFrame:
    """Approximate distinct addresses and devices per user and hour."""
    return (
        with_event_time(sessions, "ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "user_id")
        .agg(F.approx_count_distinct("ip").alias("ips"), F.approx_count_distinct("platform").alias("devices"), F.count(F.lit(1)).alias("sessions"))
        .select(F.col("w.start").alias("window_start"), "user_id", "ips", "devices", "sessions")
    )


def lockouts(events: DataFrame, policy: LockoutPolicy = LockoutPolicy()) -> DataFrame:
    """Outcome of every login attempt with per-user state.

    State is dropped by a timer once neither the lock nor the counter can matter.
    """

    def attempt(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        current = tuple(state.get) if state.exists else FRESH
        outcomes, counts = [], []
        for us, success in zip(rows["us"], rows["success"]):
            current, outcome = advance(current, int(us), bool(success), policy)
            outcomes.append(outcome)
            counts.append(current[0])
        if current == FRESH:
            if state.exists:
                state.remove()
        else:
            state.update(current)
            ends = max(int(rows["us"].iloc[-1]), current[2]) // 1000 + policy.reset_seconds * 1000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "event_id": rows["event_id"].values, "user_id": key[0], "outcome": outcomes,
            "failed_attempts": pd.Series(counts, dtype="int32"),
        })

    timed = with_event_time(events, "ts").withColumn("us", F.unix_micros("ts"))
    return timed.select("event_id", "user_id", "us", "success", "ts").groupBy("user_id").applyInPandasWithState(
        attempt, OUTCOME, "failed int, first long, until long", "append", GroupStateTimeout.EventTimeTimeout
    )


MONTH_LATE = "62 days"


def live_spending(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Running spending per user, month and top-level category, as budgets count it.

    The state holds about three months: a month leaves it, and rows of it are
    late, once a month that begins ``MONTH_LATE`` after it has been seen.
    """
    parents = categories.select("category_id", F.coalesce("parent_id", "category_id").alias("group_id"))
    first_day = F.date_trunc("month", F.col("transaction_date").cast("timestamp"))
    return (
        transactions.filter(~F.col("is_deleted") & (F.col("transaction_type") == "DEBIT"))
        .join(parents, "category_id")
        .withColumn("first_day", first_day)
        .withWatermark("first_day", MONTH_LATE)
        .groupBy("user_id", "first_day", "group_id")
        .agg(F.sum("amount").alias("spent"), F.count(F.lit(1)).alias("n"))
        .select("user_id", F.date_format("first_day", "yyyy-MM").alias("month"), F.col("group_id").alias("category_id"), "spent", "n")
    )


def budget_alerts(spending: DataFrame, budgets: DataFrame) -> DataFrame:
    """Budgets reached by the updated totals."""
    b = budgets.select("budget_id", "user_id", "category_id", "amount_limit", "alert_threshold")
    share = F.col("spent").cast("double") / F.col("amount_limit").cast("double")
    return (
        spending.join(b, ["user_id", "category_id"])
        .withColumn("level", F.when(share > 1, "over").when(share >= F.col("alert_threshold"), "near"))
        .filter("level IS NOT NULL")
    )


def watch_budgets(transactions: DataFrame, categories: DataFrame, budgets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the alerts of every micro-batch's updated totals."""

    def each(batch: DataFrame, batch_id: int) -> None:
        budget_alerts(batch, budgets).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start(live_spending(transactions, categories), checkpoint, mode="update", each_batch=each)
