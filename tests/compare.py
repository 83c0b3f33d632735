"""Run registered queries and their SQL twins side by side: compare.py FOLDER [name ...]."""

import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def compare(spark, connection, folder, name):
    started = time.time()
    frame = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got)})", seconds
    result = connection.sql(sql)
    want = result.fetchall()
    if sorted(frame.columns) != sorted(result.columns):
        return f"COLUMNS {sorted(frame.columns)} / {sorted(result.columns)}", seconds
    a, b = rows_of(frame.columns, got), rows_of(result.columns, want)
    if a == b:
        return f"equal ({len(a)})", seconds
    left, right = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"DIFFERS {len(a)}/{len(b)}\n   spark {left}\n   duck  {right}"[:1500], seconds


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    for name in names or entry.queries():
        try:
            outcome, seconds = compare(spark, connection, folder, name)
        except Exception as error:
            outcome, seconds = "ERROR " + str(error)[:1200], 0.0
        print(f"{name}: {outcome} [{seconds:.1f}s]", flush=True)
