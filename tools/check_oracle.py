"""Compare registered queries with their oracle SQL.

    python tools/check_oracle.py [--sf 0.01] [name ...]

Columns are compared by name, rows without order, doubles to nine significant digits.
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def normal(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if value == int(value) and abs(value) < 1e15:
            return str(int(value))
        return f"{value:.9g}"
    if isinstance(value, Decimal):
        return normal(float(value))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{normal(v)}" for k, v in value.items()) + "}"
    if hasattr(value, "asDict"):
        return normal(value.asDict())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(con, df, sql: str | None) -> tuple[bool, str]:
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no oracle)"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: only spark {set(df.columns) - set(names)}, only oracle {set(names) - set(df.columns)}"
    want = rows_of(names, result.fetchall())
    if got == want:
        kinds = dict(df.dtypes)
        return True, f"{len(got)} rows; types " + ",".join(
            f"{d[0]}:{kinds[d[0]]}/{d[1]}" for d in result.description if not _same(kinds[d[0]], str(d[1])))
    extra, lack = set(got) - set(want), set(want) - set(got)
    cols = sorted(names)
    return False, (f"spark {len(got)} oracle {len(want)} rows; columns {cols}\n   only spark  {sorted(extra)[:3]}"
                   f"\n   only oracle {sorted(lack)[:3]}")


def _same(spark_type: str, duck_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    return pairs.get(spark_type) == duck_type


def main() -> int:
    from tallyward.catalog import registered
    from tallyward.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, (query, sql) in registered().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            ok, note = compare(con, query(spark, sf_dir), sql)
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
