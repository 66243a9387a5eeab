"""Run the registered queries beside their SQL in DuckDB and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        number = float(value)
        return (1, "nan" if math.isnan(number) else repr(0.0 if number == 0 else number))
    return (1, repr(value) if isinstance(value, (list, tuple)) else str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


WIDTHS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder, name, run, sql):
    """None if equal, else what differs; and the seconds of both sides."""
    began = time.time()
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - began
    if sql is None:
        return None, len(got), spark_time, 0.0, ""
    began = time.time()
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    duck_time = time.time() - began
    widths = [
        f"{f.name}: {f.dataType.simpleString()} / {types.get(f.name)}"
        for f in df.schema.fields
        if WIDTHS.get(f.dataType.simpleString()) != types.get(f.name)
    ]
    names, left = rows_of(df.columns, got)
    other, right = rows_of(list(types), want)
    note = "; ".join(widths)
    if names != other:
        return f"columns {names} / {other}", len(got), spark_time, duck_time, note
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        text = f"rows {len(left)} / {len(right)}; only Spark {only_left}; only SQL {only_right}"
        return text[:700], len(got), spark_time, duck_time, note
    return None, len(got), spark_time, duck_time, note


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen and name.split("_")[0] not in chosen:
            continue
        try:
            wrong, rows, a, b, note = compare(spark, con, folder, name, run, sql.get(name))
        except Exception as error:  # noqa: BLE001
            wrong, rows, a, b, note = f"{type(error).__name__}: {str(error)[:900]}", 0, 0, 0, ""
        state = "BAD " if wrong else ("ok  " if name in sql else "rows")
        bad += bool(wrong)
        print(f"{state} {name:28s} {rows:7d} rows  spark {a:6.2f}s  sql {b:6.2f}s  {note}", flush=True)
        if wrong:
            print("     ", wrong, flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
