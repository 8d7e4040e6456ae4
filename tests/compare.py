"""Run one registered query on Spark and its SQL on DuckDB and compare the values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    if isinstance(v, dict):
        return {k: normal(x) for k, x in v.items()}
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in data)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, folder: str, fn, sql: str | None):
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    names, want = oracle(folder, sql)
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return len(got), ""
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    only_a, only_b = ([x[:150] + " ... " + x[-150:] if len(x) > 300 else x for x in xs] for xs in (only_a, only_b))
    return len(got), f"{len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from harrow.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [q for q in queries if not args or any(q.startswith(a) for a in args)]:
        start = time.time()
        try:
            n, problem = compare(spark, folder, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        verdict = "rows" if problem is None else "ok" if problem == "" else "BAD"
        bad += verdict == "BAD"
        print(f"{verdict:5} {name:32} {n:8} {time.time() - start:6.2f}s {(problem or '')[:1800]}", flush=True)
    print("bad:", bad)
