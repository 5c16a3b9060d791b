"""Runs a query in Spark and its SQL in DuckDB over the same folder and compares rows as multisets."""

from __future__ import annotations

import datetime as dt
import math
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal)):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


#: Queries that SQL can not state, and the tests that check what they return. Any other query without SQL is a failure.
CHECKED = {
    "p1_nodes": "tests/test_nested.py: labels against a walk of the record",
    "hash_sample": "tests/test_operators.py: the same rows on every partitioning",
    "model_predictions": "tests/test_sources_streams.py: training, scoring and the store",
    "feature_importance": "tests/test_learning.py: the feature that decides comes first",
    "greedy_matches": "tests/test_learning.py: against a loop over all pairs",
    "match_modes": "tests/test_operators.py: strategies and accepted labels",
    "quartile_misses": "tests/test_operators.py: the misses of picked documents",
    "volume_contributions": "tests/test_learning.py: against the exact volume",
    "feature_search": "tests/test_learning.py: search, resume and rules",
    "isolated_updates": "tests/test_records.py: a failure stays with its own job",
}


def compare(spark, con, query, sql: str | None, sf_dir: str, checked: str | None = None, need_rows: bool = True) -> dict:
    """{ok, rows, sec, why}; without SQL the query must name its own check; no rows are a failure, but on the smallest data."""
    t = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    out = {"rows": len(got), "sec": round(time.time() - t, 2), "ok": True, "why": "" if sql else f"no SQL; {checked}"}
    if not got and need_rows:
        return out | {"ok": False, "why": "no rows, so nothing is compared"}
    if not sql:
        return out if checked else out | {"ok": False, "why": "neither SQL nor a check of its own"}
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return out | {"ok": False, "why": f"columns {sorted(df.columns)} / {sorted(names)}"}
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        more, less = list((a - b).elements())[:3], list((b - a).elements())[:3]
        out |= {"ok": False, "why": f"{len(got)} / {len(want)} rows; only Spark {more}; only SQL {less}"}
    return out
