"""Compare registered queries with their SQL: python tests/compare.py FOLDER [name ...]"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(
        tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows
    )


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    cur = con.execute(sql)
    return bag([d[0] for d in cur.description], cur.fetchall())


def difference(spark, con, folder, name):
    """Empty when Spark and SQL agree, else a short account."""
    start = time.time()
    columns, rows = spark_bag(entry.queries()[name](spark, folder))
    took = time.time() - start
    sql_columns, sql_rows = sql_bag(con, entry.oracle_sql()[name])
    count = sum(rows.values())
    print(f"{name:26s} {count:8d} rows  {took:6.2f} s  duckdb {time.time() - start - took:6.2f} s", flush=True)
    if columns != sql_columns:
        return f"columns {columns} / {sql_columns}"
    if rows != sql_rows:
        return f"only Spark {list((rows - sql_rows).items())[:3]} only SQL {list((sql_rows - rows).items())[:3]}"
    return "" if count else "no rows"


def main(folder, *names):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    for name in names or entry.queries():
        try:
            problem = difference(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__} {str(e)[:600]}"
        if problem:
            print("   DIFFERS", problem)


if __name__ == "__main__":
    main(*sys.argv[1:])
