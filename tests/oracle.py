"""Run a registered query in Spark and its SQL in DuckDB; compare like the
driver does: row count, column names (sorted) and an order-insensitive value
multiset. Usable from pytest and as a script:

    python -m tests.oracle [name ...] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import sys
import time

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)          # exact, like a value hash
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def compare(spark, name: str, sf_dir: str, con=None, show: int = 5) -> dict:
    from corpusmap.plans.registry import ORACLE_SQL, QUERIES
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    scols = sorted(sdf.columns)
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE_SQL:
        res["status"] = "rows-only"
        return res
    cur = con.execute(ORACLE_SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    res["duck_rows"] = len(drows)
    res["duck_sec"] = round(time.time() - t1, 2)
    if sorted(dcols) != scols:
        res["status"] = f"columns differ: spark={scols} duck={sorted(dcols)}"
        return res
    sc = collections.Counter(tuple(_norm(r[c]) for c in scols) for r in srows)
    dc = collections.Counter(tuple(_norm(r[c]) for c in scols) for r in drows)
    if sc == dc:
        res["status"] = "match"
    else:
        only_s = list((sc - dc).elements())[:show]
        only_d = list((dc - sc).elements())[:show]
        res["status"] = f"values differ ({sum((sc - dc).values())} spark-only, {sum((dc - sc).values())} duck-only)"
        res["cols"] = scols
        res["spark_only"] = only_s
        res["duck_only"] = only_d
    return res


def main(argv):
    sf = "/root/testdata/sf0.01"
    names = []
    it = iter(argv)
    for a in it:
        if a == "--sf":
            sf = next(it)
        else:
            names.append(a)
    sys.path.insert(0, ".")
    from corpusmap.plans.registry import QUERIES
    from corpusmap.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    bad = 0
    for n in names or list(QUERIES):
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
