"""Run catalog queries against DuckDB: python tests/check_catalog.py [sf_dir] [name part…]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v) + 0.0
    return str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def compare(df, con, sql):
    names, rows = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("rows only", len(rows)) if rows else ("EMPTY", 0)
    cur = con.execute(sql)
    want_names, want = sorted_rows([c[0] for c in cur.description], cur.fetchall())
    if names != want_names:
        return "COLUMNS", (names, want_names)
    if len(rows) != len(want):
        return "ROWS", (len(rows), len(want))
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return ("VALUES", (len(bad), bad[:3])) if bad else ("ok", len(rows))


def main() -> int:
    from pyspark.sql import SparkSession

    from catalog import all_entries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for e in all_entries():
        if parts and not any(p in e.name for p in parts):
            continue
        start = time.time()
        try:
            status, info = compare(e.run(spark, sf_dir), con, e.sql)
        except Exception as err:  # noqa: BLE001
            status, info = "ERROR", f"{type(err).__name__}: {str(err)[:700]}"
        good = status in ("ok", "rows only")
        failed += not good
        print(f"{'  ' if good else '!!'} {e.name:32s} {time.time() - start:6.2f}s {status} {info}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
