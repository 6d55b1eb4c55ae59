"""Compare registered queries with their SQL in DuckDB.

    python tests/check_queries.py [folder] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    names, ours = table(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    sql_names, theirs = table([c[0] for c in cur.description], cur.fetchall())
    if names != sql_names:
        return f"columns {names} vs {sql_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    if ours != theirs:
        diff = next((a, b) for a, b in zip(ours, theirs) if a != b)
        n = sum(a != b for a, b in zip(ours, theirs))
        return f"{n} of {len(ours)} rows differ, first {diff[0]} vs {diff[1]}"
    return None


def main(folder, parts):
    from tests.conftest import make_session
    import __spark_entry__ as entry

    spark = make_session()
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, build in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                rows = "" if problem else con.execute(f"select count(*) from ({sqls[name].rstrip().rstrip(';')})").fetchone()[0]
            else:
                got = df.collect()
                rows, problem = f"{len(got)} no sql", None if got else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            rows, problem = "", f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if problem else 'ok':5}{name:34}{time.time() - begin:6.1f}s {rows} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(len(bad), "failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(main(where, args))
