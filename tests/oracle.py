"""Compare registered queries with their SQL forms; ``python tests/oracle.py [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("minekit")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def warehouse(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return ("null", None)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("null", None) if math.isnan(value) else ("float", repr(value + 0.0))
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return (type(value).__name__, value.isoformat())
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, (list, tuple)):
        return ("list", tuple(map(canonical, value)))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(canonical(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark_df, con, sql) -> tuple[str | None, float]:
    """The difference (None when equal) and the seconds the SQL form took."""
    got_cols, got = rows_of(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    start = time.time()
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    took = time.time() - start
    return difference(got_cols, got, want_cols, want), took


def difference(got_cols, got, want_cols, want) -> str | None:
    """None when equal, else a short description of the difference."""
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        cells = [(c, x, y) for c, x, y in zip(got_cols, *wrong[0]) if x != y]
        return f"{len(wrong)} of {len(got)} rows differ, first {cells[:4]} in {[v for _, v in wrong[0][0]][:6]}"
    return None


def main(names, folder="/root/testdata/sf0.01") -> int:
    from minekit.plans import all_queries

    spark, con = session(), warehouse(folder)
    bad = 0
    for name, q in all_queries().items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        start = time.time()
        try:
            if q.sql:
                problem, seconds = compare(q.run(spark, folder), con, q.sql)
                if seconds > 5:
                    print(f"     sql of {name} took {seconds:.1f}s")
                state = problem or "ok"
            else:
                state = f"rows {q.run(spark, folder).count()}"
                problem = None
        except Exception as e:  # noqa: BLE001
            problem = state = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        flag = "FAIL" if problem else "    "
        took = time.time() - start
        if problem or names or took > 8 or not q.sql:
            print(f"{flag} {took:5.1f}s {name}: {state}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]) > 0)
