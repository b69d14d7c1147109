"""Compare registered queries with their SQL: python tests/compare.py [sf] [names...]."""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(float(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql):
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = rows_of(expected_columns, result.fetchall())
    if sorted(spark_df.columns) != sorted(expected_columns):
        return [f"columns {sorted(set(spark_df.columns) ^ set(expected_columns))}"]
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == expected:
        return []
    only_got, only_expected = sorted(set(got) - set(expected)), sorted(set(expected) - set(got))
    names = sorted(expected_columns)
    shown = [f"rows {len(got)} vs {len(expected)}, {len(only_got)} differ"]
    for g, e in list(zip(only_got, only_expected))[:3]:
        shown.append(str([(n, a, b) for n, a, b in zip(names, g, e) if a != b][:8]))
    return shown


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), entry.oracle_sql()
    failed = []
    for name, function in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            if name in sqls:
                problems = differences(df, con, sqls[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.2f}s", *problems, sep="\n    ", flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
