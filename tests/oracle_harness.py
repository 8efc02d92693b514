"""Run a registered query on Spark and its SQL on DuckDB, compare like the driver.

Row count, column names (sorted), per-column value type family and the
order-insensitive multiset of rows must all agree.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("null", None)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("null", None)
        return ("float", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, _dt.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, _dt.date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("map", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return ("str", str(v))


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> list[str]:
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        return [f"columns differ: spark={sorted(spark_cols)} duck={sorted(duck_cols)}"]
    if len(spark_rows) != len(duck_rows):
        problems.append(f"row count spark={len(spark_rows)} duck={len(duck_rows)}")
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    s = sorted(tuple(_norm(r[i]) for i in si) for r in spark_rows)
    d = sorted(tuple(_norm(r[i]) for i in di) for r in duck_rows)
    # type families per column
    for j, c in enumerate(order):
        st = {x[j][0] for x in s} - {"null"}
        dt = {x[j][0] for x in d} - {"null"}
        if st and dt and st != dt:
            problems.append(f"type of {c}: spark={st} duck={dt}")
    if s != d:
        ss, dd = set(s), set(d)
        only_s = [x for x in s if x not in dd][:3]
        only_d = [x for x in d if x not in ss][:3]
        problems.append(f"values differ; spark-only={only_s} duck-only={only_d}")
    return problems


def run(names=None, sf_dir="/root/testdata/sf0.01", verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tallyscope.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    names = list(qs) if not names else names
    failures = {}
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            failures[name] = [f"spark error: {type(e).__name__}: {str(e)[:400]}"]
            print(f"[FAIL] {name}: {failures[name]}") if verbose else None
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"[rows-only] {name}: {len(srows)} rows ({t1 - t0:.1f}s)") if verbose else None
            continue
        try:
            cur = con.execute(sqls[name])
            drows = cur.fetchall()
            dcols = [x[0] for x in cur.description]
        except Exception as e:  # noqa: BLE001
            failures[name] = [f"duckdb error: {str(e)[:400]}"]
            print(f"[FAIL] {name}: {failures[name]}") if verbose else None
            continue
        probs = compare(srows, scols, drows, dcols)
        if probs:
            failures[name] = probs
        if verbose:
            tag = "FAIL" if probs else "ok"
            print(f"[{tag}] {name}: {len(srows)} rows spark {t1 - t0:.1f}s {'; '.join(probs)[:1500]}")
    return failures


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    fails = run(args or None, sf)
    print("FAILURES:", sorted(fails))
