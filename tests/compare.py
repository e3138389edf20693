"""Run registered queries and their DuckDB twins side by side.

    python -m tests.compare [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    return a == b


def _key(row):
    return tuple((v is None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def differences(spark_df, con, sql: str) -> tuple[str, int, int]:
    """Empty text if both have the same columns and the same bag of rows."""
    columns = sorted(spark_df.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", len(rows), -1
    at = [names.index(c) for c in columns]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}", len(rows), 0
    exact = 0
    for a, b in zip(sorted(rows, key=_key), sorted(want, key=_key), strict=True):
        if not all(_same(x, y) for x, y in zip(a, b, strict=True)):
            return f"{dict(zip(columns, a, strict=True))} != {b}", len(rows), exact
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {[type(x) for x in a]} {[type(x) for x in b]}", len(rows), exact
        exact += a == b
    return "", len(rows), exact


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = make_session(), duck(sf_dir), oracle_sql()
    bad = 0
    for name, job in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = job(spark, sf_dir)
            if name in sql:
                text, n, exact = differences(df, con, sql[name])
                verdict = f"DIFF {text}" if text else f"ok ({exact}/{n} bit-equal)"
            else:
                n = len(df.collect())
                verdict = f"no oracle, {n} rows"
        except Exception as e:  # noqa: BLE001  report and go on
            n, verdict = -1, f"FAIL {type(e).__name__} {str(e)[:600]}"
        bad += verdict.startswith(("DIFF", "FAIL")) or n == 0
        print(f"{name:42s} {time.time() - t:6.1f}s {n:7d} {verdict}", flush=True)
    print("bad or empty:", bad)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    main()
