"""Compare registered queries with their oracle SQL: ``python tests/parity.py [sf] [name ...]``."""

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from traceloom.plans.views import TABLES  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_integer_ratio"):
        number = float(value)
        return int(number) if number == int(number) else float(f"{number:.9g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def duck(sf):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, sf, name):
    """None when equal, else a short text of the difference."""
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        return None, sum(got.values())
    result = con.execute(text)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}", 0
    at = [names.index(c) for c in columns]
    want = Counter(tuple(_plain(row[i]) for i in at) for row in result.fetchall())
    if got == want:
        return None, sum(got.values())
    return (f"{sum(got.values())} vs {sum(want.values())} rows; only spark "
            f"{list((got - want).items())[:2]}; only sql {list((want - got).items())[:2]}"), 0


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    from traceloom.session import build_session
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in argv[1:] or entry.queries():
        began = time.time()
        try:
            wrong, rows = compare(spark, con, sf, name)
        except Exception as error:                                   # noqa: BLE001
            wrong, rows = f"{type(error).__name__}: {str(error)[:700]}", 0
        bad += wrong is not None
        note = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'FAIL' if wrong else 'ok'} {name} {rows} rows {time.time() - began:.1f}s{note}"
              + (f"\n   {wrong}" if wrong else ""), flush=True)
    print(f"{bad} wrong")


if __name__ == "__main__":
    main(sys.argv[1:])
