"""Compare every query that has SQL with DuckDB: python tests/oracle.py [SF_DIR] [NAME...]."""

import math
import os
import sys
import tempfile
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 9)
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def difference(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} but {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows but {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"row {a} but {b}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(sf), entry.oracle_sql(), 0
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            found = difference(session, con, sf, entry.queries()[name], sql[name])
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - t:.1f} {found or ''}", flush=True)
    sys.exit(bad > 0)
