"""Runs registered queries beside their oracle SQL and reports differences.

    python tests/compare.py [name pattern ...]   (SF_DIR names the tables, default sf0.01)
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)
    return names, data


def run_pair(spark, con, name, queries, oracles, sf):
    df = queries[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return -1, "a join pairs all rows"
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got[1]), "rows only"
    cur = con.execute(oracles[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return len(got[1]), f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got[1]), f"first difference\n  got  {a}\n  want {b}"
    return len(got[1]), None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from marginalia.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, os_ = duck(sf), queries(), oracle_sql()
    wanted = [n for n in qs if not sys.argv[1:] or any(p in n for p in sys.argv[1:])]
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            n, problem = run_pair(spark, con, name, qs, os_, sf)
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem not in (None, "rows only")
        print(f"{'ok  ' if problem is None else 'ROWS' if problem == 'rows only' else 'FAIL'} {name} rows={n} "
              f"{time.time() - t:.1f}s {problem if problem not in (None, 'rows only') else ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} differ")
