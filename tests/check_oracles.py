"""Run every registered query on Spark and its oracle on DuckDB; compare.

    python tests/check_oracles.py [sf_dir] [name,name,...]

Prints one line per query: row counts, column sets and an order-insensitive
value hash (floats rounded to 6 places, columns sorted by name).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from kbpipe.session import build_session  # noqa: E402
from kbpipe.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        v = v.item()
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    rows = rows_of(pdf)
    return len(rows), sorted(pdf.columns), hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def rows_of(pdf: pd.DataFrame) -> list[str]:
    cols = sorted(pdf.columns)
    # DuckDB hands integers with NULLs over as Int64, Spark as float64
    pdf = pdf.astype({c: "float64" for c in cols if str(pdf[c].dtype) in ("Int64", "Int32")})
    return sorted("\x1f".join(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(qs)
    if os.environ.get("PLAIN_SESSION"):
        # as a caller with Spark's defaults would run the queries
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session("local[8]", shuffle_partitions=8, spread_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            s = qs[n](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-FAIL {n}: {str(e)[:400]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if n not in orc:
            print(f"NO-ORACLE {n}: rows={len(s)}", flush=True)
            continue
        try:
            d = con.execute(orc[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"DUCK-FAIL {n}: {str(e)[:400]}", flush=True)
            bad += 1
            continue
        a, b = digest(s), digest(d)
        ok = a == b
        bad += not ok
        print(f"{'MATCH' if ok else 'DIFF '} {n}: spark={a} duck={b} spark {t1 - t0:.1f}s", flush=True)
        if not ok and a[1] == b[1]:
            ra, rb = rows_of(s), rows_of(d)
            sa, sb = set(ra), set(rb)
            for x in list(sa - sb)[:2]:
                print("   spark only:", x[:300].replace("\n", "\\n"))
            for x in list(sb - sa)[:2]:
                print("   duck  only:", x[:300].replace("\n", "\\n"))
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
