"""Compare registered queries with their SQL on DuckDB: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


def compare(name, q, spark, sf, con):
    """Return (row count, list of problems); equality is exact after the queries' own rounding."""
    df = q.build(spark, sf)
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return len(got), []
    rel = con.execute(q.sql)
    want_c, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_c != want_c:
        return len(got), [f"columns {sorted(set(got_c) ^ set(want_c))}"]
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    gs, ws = set(got), set(want)
    if len(problems) == 0 and got != want:
        a, b = sorted(gs - ws, key=repr), sorted(ws - gs, key=repr)
        for x, y in list(zip(a, b))[:3]:
            problems.append(str([(c, u, v) for c, u, v in zip(got_c, x, y) if u != v or type(u) is not type(v)]))
        problems.insert(0, f"{len(a)} rows differ" if a else "types differ only")
    elif problems:
        problems.append(f"spark only {list(gs - ws)[:2]} sql only {list(ws - gs)[:2]}")
    return len(got), problems


def main():
    from riskpanel.plans.catalog import ALL
    from riskpanel.session import local_session

    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    names = [n for n in ALL if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark, con = local_session("8"), connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            count, problems = compare(n, ALL[n], spark, sf, con)
        except Exception as e:  # noqa: BLE001
            count, problems = -1, [f"{type(e).__name__}: {str(e)[:700]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        kind = "sql" if ALL[n].sql else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {n:34s} {count:7d} {kind:4s} {time.time() - t:6.2f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print("failed", bad, "of", len(names))


if __name__ == "__main__":
    main()
