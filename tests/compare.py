"""Run queries against DuckDB on the same tables.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in r),
    )


def difference(spark_df, db, sql):
    """None if both give the same rows, else a short account."""
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = db.execute(sql)
    expected = canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if got[1] != expected[1]:
        extra = [r for r in got[1] if r not in set(expected[1])][:3] if len(got[1]) < 50000 else got[1][:3]
        missing = [r for r in expected[1] if r not in set(got[1])][:3] if len(got[1]) < 50000 else expected[1][:3]
        return f"{len(got[1])} rows, expected {len(expected[1])}; only here {extra}; only there {missing}"
    return None if got[1] else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from logtable.plans.staging import clear_staging

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sql = connect(sf_dir), entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            found = difference(df, db, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
        clear_staging(spark)


if __name__ == "__main__":
    main()
