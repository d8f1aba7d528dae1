"""Run registered queries against the same SQL in DuckDB: ``python tests/compare.py [prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from fleetgauge.plans import load_all
from fleetgauge.plans.registry import TABLES


def oracle(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        if math.isnan(number):
            return "nan"
        return f"{number:.6g}" if abs(number) >= 1e-9 else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder):
    """None when equal, else a message."""
    frame = query.build(spark, folder)
    got = normalise(frame.columns, [tuple(r) for r in frame.collect()])
    if query.sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(query.sql)
    want = normalise([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; {got[1][:2]} {want[1][:2]}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(want[1])} rows differ ({got[0]}):\n    {wrong[0][0]}\n    {wrong[0][1]}"
    if not want[1]:
        return "both empty"
    return None


def main() -> int:
    from fleetgauge.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    bad = 0
    for name, query in load_all().items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, query, folder)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        took = time.time() - began
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failures")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
