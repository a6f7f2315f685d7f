"""Compare every query with its oracle: python -m tests.check_oracles SF_DIR [names..]"""

import math
import sys
import time
from datetime import datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        only, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return len(got), f"{len(got)} and {len(want)} rows; only {only}; missing {missing}"
    return len(got), None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir, *names = sys.argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, run, oracle.get(name))
        except Exception as e:
            n, problem = -1, f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        note = problem or ("ok" if name in oracle else "no oracle")
        print(f"{name:28s} {n:8d} {time.time() - start:6.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
