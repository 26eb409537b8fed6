"""Request limits, login lockout, sessions and audit lines over event tables.

An event table may have one key with a third of all rows. Windows over time are
therefore taken inside (key, time bucket): each event is also copied into the
next bucket, so a bucket holds everything a look-back of one width can see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.text import platform_family
from spendlake.operators.ranking import join_null_safe
from spendlake.session import checkpointed


@dataclass(frozen=True)
class Limit:
    requests: int
    burst: int = 0
    seconds: int = 60

    @property
    def total(self) -> int:
        return self.requests + self.burst


# Requests allowed per 60 seconds.
LIMITS = {
    "auth": Limit(5),
    "upload": Limit(10, 2),
    "analytics": Limit(60, 10),
    "general": Limit(100, 20),
    "sensitive": Limit(3),
    "public": Limit(1000, 100),
}


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_look_back(events: DataFrame, seconds: int) -> DataFrame:
    """Each event in its own time bucket (``own``) and, as history, in the next."""
    bucket = F.floor(F.col("us") / (seconds * 1_000_000))
    copies = F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))
    return events.withColumn("us", micros()).select("*", F.inline(copies))


def rate_limit_audit(events: DataFrame, limit: Limit, key: str = "user_id") -> DataFrame:
    """Decision for every request, counting the requests strictly inside the window before it."""
    width = limit.seconds * 1_000_000
    w = Window.partitionBy(key, "bucket").orderBy("us").rangeBetween(-(width - 1), -1)
    counted = (
        with_look_back(events, limit.seconds)
        .withColumn("prior", F.count(F.lit(1)).over(w))
        .withColumn("oldest", F.min("us").over(w))
        .filter("own")
    )
    allowed = F.col("prior") < limit.total
    reset = F.floor((F.coalesce("oldest", "us") + width) / 1_000_000)
    return counted.select(
        "event_id",
        key,
        "prior",
        allowed.alias("allowed"),
        F.when(allowed, limit.total - F.col("prior") - 1).otherwise(0).alias("remaining"),
        reset.alias("reset_at"),
        F.when(~allowed, F.greatest(F.lit(1), reset - F.floor(F.col("us") / 1_000_000))).alias("retry_after"),
    )


def suspicious_sessions(sessions: DataFrame, now: Column, max_ips: int = 3, max_types: int = 2, max_recent: int = 5) -> DataFrame:
    """Users with many addresses, device types or new sessions in the last hour."""
    age = F.unix_micros(now.cast("timestamp")) - micros()
    fine = sessions.groupBy("user_id", "ip", platform_family(F.col("platform")).alias("device")).agg(
        F.count(F.when((age >= 0) & (age < 3600 * 1_000_000), 1)).alias("recent")
    )
    s = fine.groupBy("user_id").agg(
        F.count_distinct("ip").alias("ips"), F.count_distinct("device").alias("device_types"), F.sum("recent").alias("recent_sessions")
    )
    flags = F.array_compact(F.array(
        F.when(F.col("ips") > max_ips, F.lit("multiple_ips")),
        F.when(F.col("device_types") > max_types, F.lit("multiple_device_types")),
        F.when(F.col("recent_sessions") > max_recent, F.lit("rapid_session_creation")),
    ))
    return s.withColumn("indicators", flags).filter(F.size("indicators") > 0)


# --- audit lines -----------------------------------------------------------------------


def parse_audit_lines(lines: DataFrame) -> DataFrame:
    """REQUEST, RESPONSE and ERROR lines to typed events."""
    p = F.split("line", " \\| ")
    kind, g = p[0], lambda k: F.try_element_at(p, F.lit(k))
    ms = F.regexp_extract(g(4), r"^([0-9.]+)ms$", 1).try_cast("double")
    call = F.when(kind == "REQUEST", g(4)).otherwise(g(5))
    url = F.regexp_extract(call, r"^\S+ (.*)$", 1)
    return lines.select(
        *[c for c in lines.columns if c != "line"],
        kind.alias("event_type"),
        g(2).alias("request_id"),
        F.when(kind == "REQUEST", g(3)).alias("client_ip"),
        F.when(kind == "RESPONSE", g(3).try_cast("int")).alias("status"),
        F.when(kind == "ERROR", g(3)).alias("error_type"),
        F.when(kind != "REQUEST", ms).alias("duration_ms"),
        F.regexp_extract(call, r"^(\S+) ", 1).alias("method"),
        F.substring_index(url, "?", 1).alias("path"),
    )


def auth_severity(success: Column) -> Column:
    return F.when(success, "medium").otherwise("high")


def audit_summary(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Requests, errors and latency per path in tumbling windows."""
    e = events.select(F.window(F.col("ts").cast("timestamp"), width)["start"].alias("window_start"), "path", "event_type", "duration_ms")
    counts = e.groupBy("window_start", "path").agg(
        F.count(F.when(F.col("event_type") == "REQUEST", 1)).alias("requests"),
        F.count(F.when(F.col("event_type") == "ERROR", 1)).alias("errors"),
    )
    values = e.filter("duration_ms IS NOT NULL").groupBy("window_start", "path", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    p95 = value_quantile(values, ["window_start", "path"], "duration_ms", 0.95).withColumnRenamed("quantile", "p95_ms")
    return join_null_safe(counts, p95, ["window_start", "path"], "left").select("window_start", "path", "requests", "errors", "p95_ms")


def value_quantile(values: DataFrame, keys: list[str], value: str, q: float, per_decade: int = 500) -> DataFrame:
    """(keys, quantile): the exact interpolated quantile of each key from ``values`` (keys, value, n): different values and their counts.

    A key's values are not sorted as one group: they fall into cells of equal magnitude, a prefix scan over the cells' counts
    finds the two cells that hold the places next to the quantile, and only the values of these are ranked. Counts of several batches can
    be added up beforehand.
    """
    v = F.col(value).cast("double")
    rows = values.withColumn("_cell", F.signum(v) * F.floor(F.log10(F.abs(v) + 1) * per_decade))
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    place = (F.col("_all") - 1) * F.lit(float(q))
    cells = cells.withColumn("_place", place).withColumn("_before", F.col("_upto") - F.col("_n"))
    # places count from 0; a cell holds those from _before to _upto - 1
    holds = (F.col("_before") <= F.ceil("_place")) & (F.col("_upto") > F.floor("_place"))
    needed = cells.filter(holds).select(*keys, "_cell", "_before", "_place")
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = join_null_safe(rows, needed, [*keys, "_cell"]).withColumn("_end", F.sum("n").over(inside) + F.col("_before"))
    ends = ranked.groupBy(*keys).agg(
        F.first("_place").alias("_place"),
        F.min(F.when(F.col("_end") > F.floor("_place"), v)).alias("_low"),
        F.min(F.when(F.col("_end") > F.ceil("_place"), v)).alias("_high"),
    )
    share = F.col("_place") - F.floor("_place")
    return ends.select(*keys, (F.col("_low") * (1 - share) + F.col("_high") * share).alias("quantile"))


# --- login lockout ---------------------------------------------------------------------


@dataclass(frozen=True)
class LockoutPolicy:
    max_failed: int = 5
    lock_seconds: int = 30 * 60
    reset_seconds: int = 60 * 60


OUTCOME = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("failed_attempts", T.IntegerType()),
])
FRESH = (0, -1, -1)  # failures, first failure and end of lock in microseconds (-1: none)


def advance(state: tuple[int, int, int], us: int, success: bool, policy: LockoutPolicy) -> tuple[tuple[int, int, int], str]:
    """One login attempt: blocked while locked; a success or an old first failure resets."""
    failed, first, until = state
    if until >= 0:
        if us < until:
            return state, "blocked"
        failed, first, until = FRESH
    if success:
        return FRESH, "ok"
    if first >= 0 and us - first > policy.reset_seconds * 1_000_000:
        failed, first = 0, -1
    failed, first = failed + 1, us if first < 0 else first
    if failed >= policy.max_failed:
        return (failed, first, us + policy.lock_seconds * 1_000_000), "locked"
    return (failed, first, -1), "failed"


def _replay(pdf: pd.DataFrame, state: tuple[int, int, int], policy: LockoutPolicy) -> tuple[pd.DataFrame, tuple[int, int, int]]:
    pdf = pdf.sort_values(["us", "event_id"])
    outcomes, counts = [], []
    for us, success in zip(pdf["us"], pdf["success"]):
        state, outcome = advance(state, int(us), bool(success), policy)
        outcomes.append(outcome)
        counts.append(state[0])
    out = pdf[["event_id", "user_id"]].assign(outcome=outcomes, failed_attempts=pd.Series(counts, index=pdf.index, dtype="int32"))
    return out, state


def login_sessions(events: DataFrame, policy: LockoutPolicy) -> DataFrame:
    """Cut each user's attempts where the lockout state is certainly fresh.

    That is after a gap above the reset time, and after a success that cannot
    have been blocked: fewer than ``max_failed`` failures in the reset plus
    lock time before it. The session number is a running count taken per
    (user, bucket) with bucket offsets from an aggregate.
    """
    look = policy.reset_seconds + policy.lock_seconds
    copies = with_look_back(events, look)
    part = Window.partitionBy("user_id", "bucket")
    ordered = part.orderBy("us", "event_id")
    span = part.orderBy("us").rangeBetween(-look * 1_000_000, 0)
    failures = F.count(F.when(~F.col("success"), 1)).over(span)
    sure_reset = F.col("success") & (failures < policy.max_failed)
    gap = F.col("us") - F.lag("us").over(ordered)
    cut = gap.isNull() | (gap > policy.reset_seconds * 1_000_000) | F.coalesce(F.lag("_sure").over(ordered), F.lit(False))
    rows = copies.withColumn("_sure", sure_reset).withColumn("_cut", cut.cast("int")).filter("own").select(
        "event_id", "user_id", "us", "success", "bucket", "_cut"
    )
    before = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("user_id", "bucket").agg(F.sum("_cut").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    running = F.sum("_cut").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return join_null_safe(rows, offsets.drop("_n"), ["user_id", "bucket"]).withColumn("session", running + F.col("_before")).select(
        "event_id", "user_id", "us", "success", "session"
    )


def lockout_audit(events: DataFrame, policy: LockoutPolicy = LockoutPolicy(), max_session: int = 50_000) -> DataFrame:
    """Outcome of every login attempt: ok, failed, locked or blocked.

    Sessions are independent. One above ``max_session`` rows (an attack without
    pause) is cut by time into chunks that are replayed one after the other,
    each starting from the state the previous one ended with.
    """
    rows = login_sessions(events, policy)
    sizes = rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("_n"), F.max((~F.col("success")).cast("int")).alias("_bad"))
    sized = join_null_safe(rows, sizes, ["user_id", "session"])
    # A session without failures needs no replay.
    calm = sized.filter("_bad = 0").select("event_id", "user_id", F.lit("ok").alias("outcome"), F.lit(0).alias("failed_attempts"))
    busy = sized.filter("_bad = 1")
    keys = ["user_id", "session"]

    def replay_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by session and time: the state lives for one session.
        current, state = None, FRESH
        for pdf in batches:
            outcomes, counts = [], []
            for user, session, us, success in zip(pdf["user_id"], pdf["session"], pdf["us"], pdf["success"]):
                if (user, session) != current:
                    current, state = (user, session), FRESH
                state, outcome = advance(state, int(us), bool(success), policy)
                outcomes.append(outcome)
                counts.append(state[0])
            yield pdf[["event_id", "user_id"]].assign(outcome=outcomes, failed_attempts=pd.Series(counts, index=pdf.index, dtype="int32"))

    ordered = busy.filter(F.col("_n") <= max_session).repartition(*keys).sortWithinPartitions(*keys, "us", "event_id")
    small = ordered.mapInPandas(replay_all, OUTCOME)
    done = calm.unionByName(small)
    large = busy.filter(F.col("_n") > max_session).drop("_n", "_bad")
    total = large.count()
    return done.unionByName(_replay_large(large, -(-total // max_session), policy)) if total else done


def _replay_large(large: DataFrame, parts: int, policy: LockoutPolicy) -> DataFrame:
    keys = ["user_id", "session"]
    placed = checkpointed(large.repartitionByRange(parts, *keys, "us", "event_id").withColumn("_part", F.spark_partition_id()))
    order = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_part"))
    chunks = placed.select(*keys, "_part").distinct().withColumn("_chunk", order)
    rows = checkpointed(placed.join(chunks, [*keys, "_part"]).drop("_part"))
    schema = T.StructType(OUTCOME.fields + [T.StructField(n, T.LongType()) for n in ("session", "_failed", "_first", "_until")])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        out, state = _replay(pdf, (int(first["_failed"]), int(first["_first"]), int(first["_until"])), policy)
        return out.assign(session=first["session"], _failed=state[0], _first=state[1], _until=state[2])

    results, states = None, None
    for k in range(1, chunks.agg(F.max("_chunk")).first()[0] + 1):
        now = rows.filter(F.col("_chunk") == k)
        if states is None:
            now = now.withColumns({"_failed": F.lit(0), "_first": F.lit(-1), "_until": F.lit(-1)})
        else:
            now = now.join(states, keys)
        out = checkpointed(now.groupBy(*keys).applyInPandas(replay, schema))
        states = out.select(*keys, "_failed", "_first", "_until").distinct()
        part = out.select("event_id", "user_id", "outcome", "failed_attempts")
        results = part if results is None else results.unionByName(part)
    return results
