"""Compare registered queries with their SQL: python tools/check_sql.py [sf_dir] [name ...]"""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from srcmill.plans import catalog  # noqa: E402
from srcmill.session import build_session  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return plain([(k, v[k]) for k in sorted(v)])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name):
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if name not in catalog.SQL:
        return f"rows {len(got)}", took
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf_dir}/{f}'")
    want = db.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", took
    a, b = rows_of(df.columns, got), rows_of(names, want.fetchall())
    if a != b:
        left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"DIFFERENT {len(a)} / {len(b)} spark={str(left)[:600]} sql={str(right)[:600]}", took
    return f"same {len(a)}", took


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(catalog.QUERIES)
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in wanted:
        try:
            verdict, took = compare(spark, sf_dir, name)
        except Exception as problem:
            verdict, took = f"FAILED {type(problem).__name__} {str(problem)[:500]}", 0
            if len(wanted) < 4:
                traceback.print_exc()
        print(f"{name:28s} {took:6.2f}s {verdict}", flush=True)
