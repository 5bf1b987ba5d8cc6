"""Runs each query and its SQL over the same tables: python tests/oracle.py [folder] [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def differs(spark, con, sf, name, f, sql):
    """None, or how the results differ."""
    df = f(spark, sf)
    cols = sorted(df.columns)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(clean(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"{len(got)} and {len(want)} rows; first difference {first}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(sf), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or name not in sql:
            continue
        t = time.time()
        try:
            found = differs(spark, con, sf, name, f, sql[name])
        except Exception as x:
            found = f"{type(x).__name__}: {str(x)[:600]}"
        bad += found is not None
        print(f"{name:26s} {time.time() - t:6.1f}s {found or 'same'}", flush=True)
    print("different:", bad)
