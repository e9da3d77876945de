"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares column names, row counts and an order-insensitive value hash
(floats rounded to 6 significant digits), like the round's correctness gate.
"""

from __future__ import annotations

import decimal
import hashlib
import math
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, ".")

from creditline.plans.registry import all_oracle_sql, all_queries  # noqa: E402
from creditline.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        if math.isinf(f):
            return "inf" if f > 0 else "-inf"
        return f"{f:.6g}"
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = all_queries(), all_oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        dt = time.time() - t0
        if name not in sqls:
            print(f"{name:40s} rows={len(rows):7d} spark={dt:5.1f}s (no oracle)")
            continue
        res = con.execute(sqls[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        bad += not ok
        print(f"{name:40s} rows={len(rows):7d}/{len(orows):7d} spark={dt:5.1f}s {'OK' if ok else 'MISMATCH'}")
        if not ok:
            if sorted(cols) != sorted(ocols):
                print("   cols spark:", cols, "\n   cols duck :", ocols)
            d1 = [x for x in l1 if x not in set(l2)][:3]
            d2 = [x for x in l2 if x not in set(l1)][:3]
            print("   spark-only:", d1, "\n   duck-only :", d2)
    print("mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
