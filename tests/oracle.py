"""Compare registered queries with their DuckDB oracle: rows, schema and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark, con, query, sf_dir: str) -> tuple[int, str]:
    """(row count, problem). An empty problem means equal."""
    df = query.frame(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    if query.sql is None:
        return len(got), ""
    rel = con.sql(query.oracle())
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    want_types = {n: kinds[t] for n, t in query.fields}
    have_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if want_types != have_types:
        return len(got), f"types differ: {want_types} {have_types}"
    order = [rel.columns.index(n) for n in names]
    want = [tuple(r[k] for k in order) for r in rel.fetchall()]
    if len(got) != len(want):
        return len(got), f"rows: spark {len(got)} duckdb {len(want)}"
    bad = []
    inexact = 0
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if a != b:
            close = all(
                x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(x) and math.isnan(y))))
                for x, y in zip(a, b)
            )
            if close:
                inexact += 1
            else:
                bad.append((a, b))
    if bad:
        return len(got), f"{len(bad)} rows differ, e.g. {names}\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}"
    if inexact:
        return len(got), f"{inexact} rows equal only within 1e-9"
    return len(got), ""


def main(argv: list[str]) -> None:
    from spendlake.plans import REGISTRY
    from spendlake.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    patterns = argv or [""]
    spark = local_session("8")
    con = connect(sf_dir)
    fails = 0
    for name, q in REGISTRY.items():
        if not any(name.startswith(p) for p in patterns):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1200]}"
        fails += bool(problem)
        note = "" if q.sql else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - t:.1f}s{note} {problem}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
