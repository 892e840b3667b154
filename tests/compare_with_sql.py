"""Compare every registered query with its SQL on the given tables (development helper)."""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from touchline.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("0" if v == 0 else f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(i) for i in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(i)}" for k, i in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    try:
        return norm(float(v)) if type(v).__name__ == "Decimal" else str(v)
    except Exception:
        return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data), [cols[i] for i in order]


def main(patterns, sf="0.01"):
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:
            print(f"FAIL {name}: spark {str(e)[:1500]}"); bad += 1; continue
        t1 = time.time()
        if name not in sql:
            print(f"rows {name}: {len(got)} ({t1-t0:.1f}s)"); continue
        try:
            cur = con.execute(sql[name])
            want, wcols = rows([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:
            print(f"FAIL {name}: duckdb {str(e)[:1200]}"); bad += 1; continue
        if cols != wcols:
            print(f"FAIL {name}: columns {set(cols) ^ set(wcols)}"); bad += 1
        elif got != want:
            a, b = set(got), set(want)
            print(f"FAIL {name}: rows {len(got)} vs {len(want)}; cols {cols}\n   spark only {sorted(a-b)[:3]}\n   sql only   {sorted(b-a)[:3]}"); bad += 1
        else:
            print(f"ok   {name}: {len(got)} rows ({t1-t0:.1f}s, sql {time.time()-t1:.1f}s)")
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "0.01"
    if args and args[0].startswith("sf="):
        sf = args.pop(0)[3:]
    main(args, sf)
