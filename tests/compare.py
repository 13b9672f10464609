"""Side-by-side run of a registered query and its SQL.

    python tests/compare.py [sf] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """A comparable form: floats at 9 significant decimals, nested values as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(left) != len(right):
        return f"row counts differ: spark {len(left)} sql {len(right)}; {left[:2]} | {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"rows differ ({cols}):\n   spark {a}\n   sql   {b}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tabsight.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                message = None
                print("   rows", fn(spark, sf_dir).count(), end=" ")
        except Exception as e:  # report and go on
            message = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {time.time() - t:.2f}s {message or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
