"""Run cases next to their SQL in DuckDB and compare the whole results as bags of rows."""
from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def spark_session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("tripleframe")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return Counter(tuple(norm(r[k]) for k in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return len(got), f"columns {got_cols} vs {want_cols}"
    a, b = bag(got_cols, got), bag(want_cols, want)
    if a != b:
        return len(got), f"rows {len(got)} vs {len(want)}; extra {list((a - b).items())[:3]}; missing {list((b - a).items())[:3]}"
    types = {d[0]: str(d[1]) for d in res.description}
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float") and types[f.name] not in ("DOUBLE", "FLOAT", "NUMBER")]
    return len(got), f"types of {floats}" if floats else None


def main():
    import __spark_entry__ as entry
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    pick = sys.argv[1:]
    spark, con = spark_session(), duck(sf)
    fns, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in fns.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        t0 = time.time()
        try:
            n, err = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:
            n, err = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += err is not None
        mark = "FAIL" if err else "ok  " if name in sqls else "rows"
        print(f"{mark} {name:34s} {n:8d} rows {time.time() - t0:6.2f}s {err or ''}", flush=True)
        if n == 0:
            print(f"     {name} is empty", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
