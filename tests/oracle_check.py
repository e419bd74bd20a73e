"""Run registered queries next to their DuckDB SQL and compare the results.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return f"{type(v).__name__[0]}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} rows", t1 - t0, 0.0, True
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(want_names):
        return f"COLUMNS differ {df.columns} / {want_names}", t1 - t0, t2 - t1, False
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a == b:
        return f"ok {len(a)} rows", t1 - t0, t2 - t1, True
    left = [x for x in a if x not in set(b)][:3]
    right = [x for x in b if x not in set(a)][:3]
    cols = sorted(df.columns)
    return (
        f"DIFF {len(a)} / {len(b)} rows\n  cols {cols}\n  spark {left}\n  duck  {right}",
        t1 - t0, t2 - t1, False,
    )


def main():
    import __spark_entry__ as entry
    from locusmill.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session("8")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args and name not in args:
            continue
        try:
            msg, ts, td, ok = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # show and go on
            msg, ts, td, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0, 0, False
        bad += not ok
        print(f"{name:28s} spark {ts:6.2f}s duck {td:6.2f}s  {msg}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
