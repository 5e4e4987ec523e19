"""Run a registered query on Spark and its oracle on DuckDB, and compare the results.

Usage: python tests/harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = os.environ.get("HARNESS_STRICT") == "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(df_pd):
    cols = sorted(df_pd.columns)
    out = []
    for rec in df_pd[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name: str, sf_dir: str):
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    spd = sdf.toPandas()
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "status": "no-oracle", "rows": len(spd), "spark_s": round(t1 - t0, 2)}
    opd = con.execute(sql).fetchdf()
    t2 = time.time()
    sc, sr = rows_of(spd)
    oc, orows = rows_of(opd)
    res = {"name": name, "spark_rows": len(sr), "oracle_rows": len(orows), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sc != oc:
        res.update(status="schema", spark_cols=sc, oracle_cols=oc)
    elif sr != orows:
        diff = [(a, b) for a, b in zip(sr, orows) if a != b][:2]
        res.update(status="values", first_diff=str(diff)[:800])
    else:
        res["status"] = "ok"
    return res


def main(argv):
    from vellum.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from __spark_entry__ import queries

    if os.environ.get("HARNESS_PLAIN") == "1":  # a default session, as a driver might build it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark()
    con = duck(sf_dir)
    names = names or list(queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as exc:  # noqa: BLE001
            r = {"name": n, "status": "error", "error": str(exc)[:600]}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv)
