"""Compare registered queries with their SQL counterparts.

python tests/compare.py FOLDER [NAME ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return Counter(tuple(cell(v) for v in r) for r in pdf.itertuples(index=False, name=None))


KIND = {"int8": "int", "int16": "int", "int32": "int", "int64": "int", "float32": "float", "float64": "float"}


def compare(spark_df, con, sql) -> str:
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns}
    bad = {c: k for c, k in kinds.items() if KIND.get(k[0], "x") != KIND.get(k[1], "x")}
    a, b = rows_of(got), rows_of(want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{sum(a.values())} vs {sum(b.values())} rows; {sorted(got.columns)}\n  spark {only_a}\n  sql   {only_b}"
    if bad and len(got):
        return f"types {bad}"
    return "" if len(got) else "EMPTY"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from quire.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    root, names = sys.argv[1], sys.argv[2:]
    con = connect(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                said = compare(fn(spark, root), con, oracle[name])
                n = ""
            else:
                n = f" rows={fn(spark, root).count()}"
                said = ""
        except Exception as e:  # report and go on
            said, n = f"{type(e).__name__}: {str(e)[:900]}", ""
        failed += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} {time.time() - t0:.1f}s{n}{' NOSQL' if name not in oracle else ''} {said}", flush=True)
    print("failed", failed)
