"""Run registered queries beside their oracle SQL and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from glob import glob

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.10g}"
    if isinstance(value, bool):
        return str(value)
    return "∅" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, sf_dir) -> str | None:
    """None when both sides agree, else a short description."""
    frame = query(spark, sf_dir)
    ours = _rows(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}; ours {ours[:1]} theirs {theirs[:1]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, {sorted(names)}: {bad[0]}" if bad else None


def main(sf_dir: str, only: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            if name in sqls:
                problem = differences(spark, con, query, sqls[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            lines = str(error).strip().splitlines() or traceback.format_exc().splitlines()
            problem = " | ".join(lines[:4])
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {(problem or '')[:900]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
