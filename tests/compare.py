"""Run registered queries next to their SQL twins."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, queries, oracles, folder):
    """None when both sides agree, else a description of the first differences."""
    result = queries[name](spark, folder)
    columns, got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if name not in oracles:
        return None if got else "no rows"
    cursor = connection.execute(oracles[name])
    expected_columns, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(got)][:3]
        return f"{len(got)} rows, expected {len(expected)}; extra {extra}; missing {missing}"
    return None if got else "no rows on both sides"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from sheetloom import build_session

    folder = sys.argv[1]
    spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, connection = contract.queries(), contract.oracle_sql(), oracle(folder)
    bad = 0
    for name in [n for n in queries if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]:
        started = time.time()
        try:
            problem = compare(spark, connection, name, queries, oracles, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - started:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)
