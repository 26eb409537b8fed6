"""Invariants, brute-force comparisons and plan shapes."""

import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spendlake.operators import analytics, dedup, ranking
from spendlake.operators.filters import active
from spendlake.sources import delimited, files
from spendlake.streaming import audit

AS_OF = dt.date(2000, 6, 15)


def plan_of(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_shares_and_totals(inputs):
    rows = analytics.category_breakdown(inputs.transactions, inputs.categories, AS_OF, dt.date(1995, 1, 1), AS_OF)
    r = rows.groupBy("user_id").agg(F.sum("amount").alias("s"), F.first("total_amount").alias("t"), F.sum("percentage").alias("p")).collect()
    assert r and all(x["s"] == x["t"] and abs(x["p"] - 100) < 0.1 for x in r)


def test_pages_cover_all_rows(inputs):
    rows = active(inputs.transactions)
    size, users = 40, rows.groupBy("user_id").count().agg(F.max("count")).first()[0]
    seen = []
    for k in range(1, -(-users // size) + 1):
        seen += [r["txn_id"] for r in ranking.page(rows, k, size).select("txn_id").collect()]
    assert sorted(seen) == sorted(r["txn_id"] for r in rows.select("txn_id").collect())


def test_top_k_limits_before_the_shuffle(inputs):
    plan = plan_of(ranking.page(active(inputs.transactions), 1, 20))
    assert "WindowGroupLimit" in plan.split("Exchange")[0] and plan.count("WindowGroupLimit") >= 2


def test_period_filter_reaches_the_scan(spark, inputs, tmp_path):
    path = str(tmp_path / "t")
    inputs.transactions.write.parquet(path)
    plan = plan_of(analytics.trend_series(spark.read.parquet(path), AS_OF))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(transaction_date" in plan
    assert "merchant_name" not in plan


def test_half_split_matches_brute_force(spark):
    rnd = random.Random(1)
    data = [(u, k, dt.datetime(2000, 1, 1 + rnd.randrange(6), rnd.randrange(24)), float(rnd.randrange(1, 500))) for u in range(12) for k in range(u)]
    df = spark.createDataFrame(data, "user_id int, txn_id int, transaction_date timestamp, a double").withColumn("amount", F.col("a").cast("decimal(15,2)"))
    got = {r["user_id"]: r["trend"] for r in ranking.half_split_trend(df, ["user_id"]).collect()}
    for u in range(2, 12):
        rows = [r[3] for r in sorted((r for r in data if r[0] == u), key=lambda r: (r[2], r[1]))]
        m = len(rows) // 2
        first, later = sum(rows[:m]) / m, sum(rows[m:]) / (len(rows) - m)
        want = "stable" if len(rows) < 4 else "up" if later > first * 1.15 else "down" if later < first * 0.85 else "stable"
        assert got[u] == want, u


def _similar_rows(n: int):
    rnd = random.Random(7)
    words = ["coffee shop", "coffee shop 1", "cofee shop", "grocery store", "grocery stores", "fuel", "fuel station"]
    return [
        (k, rnd.randrange(2), 10000 + rnd.randrange(4), "DEBIT", rnd.choice(words) + rnd.choice(["", "", " x"]), dt.datetime(2000, 1, 1 + rnd.randrange(2)), rnd.choice(["", "", "R1", "R2"]))
        for k in range(n)
    ]


def _brute_force(rows):
    kept, out = [], {}
    for k, user, cents, kind, desc, day, ref in rows:
        dup = any(
            (u, t, d) == (user, kind, day) and abs(c - cents) <= 1
            and ((ref and ref == r) or SequenceMatcher(None, desc, s).ratio() > 0.8)
            for _, u, c, t, s, d, r in kept
        )
        if not dup:
            kept.append((k, user, cents, kind, desc, day, ref))
        out[k] = not dup
    return out


def test_greedy_removal_matches_one_pass(spark):
    rows = _similar_rows(300)
    df = spark.createDataFrame(rows, "txn_id long, user_id int, c int, transaction_type string, description string, transaction_date timestamp, reference string")
    df = df.withColumn("amount", (F.col("c") / 100).cast("decimal(15,2)"))
    want = _brute_force(rows)
    for head in (2000, 7):
        got = {r["txn_id"]: r["is_kept"] for r in dedup.remove_duplicates(df, head=head).collect()}
        assert got == want, head


def test_first_duplicates_by_ratio_match_all_pairs(spark):
    rows = _similar_rows(200)
    df = spark.createDataFrame(rows, "txn_id long, user_id int, c int, transaction_type string, description string, transaction_date timestamp, reference string")
    df = df.withColumn("amount", (F.col("c") / 100).cast("decimal(15,2)"))
    alike = lambda x, y: x[1] == y[1] and x[5] == y[5] and abs(x[2] - y[2]) <= 1 and ((x[6] and x[6] == y[6]) or SequenceMatcher(None, x[4], y[4]).ratio() > 0.8)
    first = {r[0]: min((o[0] for o in rows[:k] if alike(r, o)), default=None) for k, r in enumerate(rows)}
    got = {r["txn_id"]: r["duplicate_of"] for r in dedup.near_duplicates(df, method="ratio", head=7).collect()}
    assert got == {k: v for k, v in first.items() if v is not None}


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _edited_rows(n: int):
    """Texts of all lengths with zero to a few edits between them, on near days and amounts."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abc é") for _ in range(k)) for k in (0, 1, 2, 4, 5, 6, 9, 10, 11, 19, 20, 24, 31)]
    rows = []
    for k in range(n):
        text = list(rnd.choice(texts))
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(text) + 1)
            text[at : at + rnd.randrange(2)] = rnd.choice(["", "z", "a"])
        rows.append((k, 1, 10000 + rnd.randrange(5), "DEBIT", "".join(text), dt.datetime(2000, 1, 1 + rnd.randrange(3)), rnd.choice([""] * 9 + ["R1"])))
    return rows


def _like(new, old, days: int) -> bool:
    (_, u, c, t, s, d, r), (_, v, e, w, o, f, q) = new, old
    near = u == v and t == w and abs((d - f).days) <= days and abs(c - e) <= 1
    return near and (bool(r) and r == q or 1 - _distance(s, o) / max(len(s), len(o), 1) > 0.8)


def test_edit_index_matches_all_pairs(spark):
    rows = _edited_rows(220)
    df = spark.createDataFrame(rows, "txn_id long, user_id int, c int, transaction_type string, description string, transaction_date timestamp, reference string")
    df = df.withColumn("amount", (F.col("c") / 100).cast("decimal(15,2)"))
    for days in (0, 1):
        first = {r[0]: min((o[0] for o in rows[:k] if _like(r, o, days)), default=None) for k, r in enumerate(rows)}
        kept = []
        for r in rows:
            if not any(_like(r, o, days) for o in kept):
                kept.append(r)
        assert len(kept) > 20
        for head in (64, 6) if days else (6,):
            got = {r["txn_id"]: r["duplicate_of"] for r in dedup.near_duplicates(df, days=days, head=head).collect()}
            assert got == {k: v for k, v in first.items() if v is not None}, (days, head)
            flags = dedup.remove_duplicates(df, days=days, method="edit", head=head)
            assert sorted(r["txn_id"] for r in dedup.kept(flags).collect()) == [r[0] for r in kept], (days, head)


def test_removal_is_idempotent(inputs):
    once = dedup.kept(dedup.remove_duplicates(inputs.near_copies))
    assert dedup.removed(dedup.remove_duplicates(once)).count() == 0


def _logins(n: int):
    rnd = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        t += dt.timedelta(seconds=rnd.choice([0, 30, 200, 900, 4000]))
        rows.append((k, rnd.choice([1, 1, 1, 2]), t, rnd.random() < 0.25))
    return rows


def test_lockout_matches_sequential_replay(spark):
    rows = _logins(600)
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, success boolean")
    policy = audit.LockoutPolicy()
    state, want = {}, {}
    for k, user, t, ok in rows:
        us = int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        state[user], outcome = audit.advance(state.get(user, audit.FRESH), us, ok, policy)
        want[k] = outcome
    assert {"ok", "failed", "locked", "blocked"} <= set(want.values())
    for size in (50_000, 5):
        got = {r["event_id"]: r["outcome"] for r in audit.lockout_audit(df, policy, size).collect()}
        assert got == want, size


def test_stream_lockout_equals_batch(spark, inputs):
    from spendlake.plans import REGISTRY
    from tests.conftest import SF_DIR

    batch = REGISTRY["ST4_lockout"].frame(spark, SF_DIR).collect()
    stream = REGISTRY["ST4_stream_lockout"].frame(spark, SF_DIR).collect()
    assert sorted(batch) == sorted(stream)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_greedy_removal_keeps_rows_without_keys(spark):
    day = dt.datetime(2000, 1, 1)
    data = [(1, 1, day, 5.0, "DEBIT", "cafe one"), (2, 1, day, 5.0, "DEBIT", "cafe one"), (3, 1, None, 5.0, "DEBIT", "cafe"), (4, 1, None, 5.0, "DEBIT", "cafe"),
            (5, 1, day, None, "DEBIT", "cafe"), (6, None, day, 5.0, "DEBIT", "cafe one"), (7, 1, day, 5.0, None, "cafe one"), (8, 1, day, 5.0, "DEBIT", None)]
    df = spark.createDataFrame(data, "txn_id bigint, user_id int, transaction_date timestamp, amount double, transaction_type string, description string")
    got = {r["txn_id"]: r["is_kept"] for r in dedup.remove_duplicates(df).collect()}
    assert got == {k: k != 2 for k in range(1, 9)}


def test_deep_pages_keep_rows_without_a_date(spark):
    data = [(k, 1, None if k % 3 == 0 else dt.datetime(2000, 1, 1 + k % 5), dt.datetime(2000, 1, 1)) for k in range(30)]
    df = spark.createDataFrame(data, "txn_id bigint, user_id int, transaction_date timestamp, created_at timestamp")
    shallow = [[r["txn_id"] for r in ranking.page(df, n, 7).orderBy("rank").collect()] for n in range(1, 6)]
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "0")
    try:
        deep = [[r["txn_id"] for r in ranking.page(df, n, 7).orderBy("rank").collect()] for n in range(1, 6)]
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    assert shallow == deep and sorted(sum(deep, [])) == list(range(30))


def test_header_after_many_blank_lines(spark):
    lines = [("a", k, "") for k in range(50)] + [("a", 50, "Date,Description,Amount"), ("a", 51, "01/02/2000,Coffee,-12.50"), ("b", 0, "Date,Description,Amount"), ("b", 1, ""), ("b", 2, "01/02/2000,Tea,-2.00")]
    got = delimited.parse_lines(spark.createDataFrame(lines, "file string, line_no int, line string"), AS_OF).select("file", "description", "amount").collect()
    assert sorted((r["file"], r["description"], float(r["amount"])) for r in got) == [("a", "Coffee", 12.5), ("b", "Tea", 2.0)]


def test_large_files_are_read_whole(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("Date,Description,Amount\n")
        for k in range(1000):
            f.write(f"01/02/2000,{'x' * 56_000}{k},-1.00\n")
    found = files.read_files(spark, str(tmp_path))
    assert found.select("length").first()[0] > files.MAX_PARSE_BYTES
    assert files.to_lines(found).count() == 1002
    assert files.validate_files(found).select("issues").first()[0] == ["File exceeds maximum size (50MB)"]


def test_upload_removes_repeated_lines(spark, inputs):
    from spendlake.plans.ingest import uploaded

    head = "Date,Description,Amount,Type,Balance"
    row, other = "01/02/2000,GROCERY SHOP,12.50,DR,90.00", "02/02/2000,TAXI,7.00,DR,83.00"
    files = {"a": [head, row, row, other, row], "b": [head, other, row], "c": [head, row, other, other]}
    lines = [(name, n, line) for name, own in files.items() for n, line in enumerate(own)]
    rows, messages = uploaded(inputs, spark.createDataFrame(lines, "file string, line_no int, line string"))
    got = sorted((r["upload_batch_id"], float(r["amount"])) for r in rows.collect())
    assert got == [(f, a) for f in "abc" for a in (7.0, 12.5)]
    assert {r["file"]: r["warnings"] for r in messages.collect()} == {"a": ["Removed 2 duplicate transactions"], "c": ["Removed 1 duplicate transactions"]}
