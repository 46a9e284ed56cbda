"""Run registered queries on Spark and their SQL oracle on DuckDB; compare.

Usage: python tools/oracle_check.py [SF_DIR] [NAME ...]
Compares column names, row count and an order-insensitive hash of the values
(floats rounded to 6 decimals), like the correctness gate.
"""
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerline.plans.registry import all_queries  # noqa: E402
from ledgerline.session import get_spark  # noqa: E402
from ledgerline.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    qs = all_queries()
    spark = get_spark(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:10s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"{name:10s} rows-only n={len(srows)} {ts:.1f}s")
            ok += 1
            continue
        try:
            cur = con.execute(q.sql)
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"{name:10s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        same = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        if same:
            ok += 1
            print(f"{name:10s} OK n={len(srows)} {ts:.1f}s")
        else:
            bad += 1
            print(f"{name:10s} MISMATCH cols={sorted(scols) == sorted(dcols)} n={len(srows)}/{len(drows)}")
            if sorted(scols) != sorted(dcols):
                print("   spark:", scols, "\n   duck: ", dcols)
            else:
                diff_s = [x for x in ls if x not in set(ld)][:3]
                diff_d = [x for x in ld if x not in set(ls)][:3]
                print("   spark-only:", diff_s, "\n   duck-only: ", diff_d)
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
