"""Comparison of a Spark query with its DuckDB SQL on one folder of tables."""

import os
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if hasattr(x, "item"):
        return _plain(x.item())
    return str(x)


def differences(spark_rows, sql_rows, columns, sql_columns):
    """A word on the first difference, or nothing."""
    if sorted(columns) != sorted(sql_columns):
        return f"columns {sorted(columns)} and {sorted(sql_columns)}"
    order = sorted(columns)
    a = sorted(repr([_plain(r[columns.index(c)]) for c in order]) for r in spark_rows)
    b = sorted(repr([_plain(r[sql_columns.index(c)]) for c in order]) for r in sql_rows)
    if a != b:
        first = next((x for x in zip(a, b) if x[0] != x[1]), (a[len(b) :][:1], b[len(a) :][:1]))
        return f"{len(a)} and {len(b)} rows; {first}"
    return ""


def compare(spark, folder, name, query, sql, c):
    df = query(spark, folder)
    found = c.execute(sql)
    return differences([tuple(r) for r in df.collect()], found.fetchall(), df.columns, [d[0] for d in found.description])


if __name__ == "__main__":
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    connected, sqls = connection(sys.argv[1]), e.oracle_sql()
    for key, function in e.queries().items():
        if (len(sys.argv) < 3 or key in sys.argv[2:]) and key in sqls:
            try:
                print(key, compare(session, sys.argv[1], key, function, sqls[key], connected)[:400] or "ok", flush=True)
            except Exception as error:  # noqa: BLE001
                print(key, "FAILED", str(error)[:400].replace("\n", " "), flush=True)
