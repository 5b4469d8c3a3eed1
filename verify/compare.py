"""Run catalog queries on Spark and the oracle SQL on DuckDB and compare.

Usage: python -m verify.compare [sf_dir] [key ...]

Per key: row counts, column names, a coarse type class per column, and an
order-insensitive hash of the values (floats compared bit for bit, dates as
ISO text).  Prints one line per key and a summary.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _type_class(name: str) -> str:
    n = name.lower()
    if any(t in n for t in ("int", "long", "short", "byte")):
        return "int"
    if any(t in n for t in ("double", "float", "decimal", "real")):
        return "float"
    if "timestamp" in n:
        return "timestamp"
    if "date" in n:
        return "date"
    if any(t in n for t in ("string", "varchar", "char")):
        return "str"
    if "bool" in n:
        return "bool"
    return n


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    sys.path.insert(0, ".")
    from cspulse.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    from cspulse import catalog
    from verify import oracle

    qs, sqls = catalog.queries(), oracle.build()
    bad = 0
    for key, fn in qs.items():
        if only and key not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        s_cols = df.columns
        s_types = {f.name: _type_class(f.dataType.simpleString()) for f in df.schema.fields}
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if key not in sqls:
            print(f"{key:32s} rows={len(s_rows):6d} (no oracle) {t1 - t0:.2f}s")
            continue
        rel = con.sql(sqls[key])
        d_cols = rel.columns
        d_types = {c: _type_class(str(t)) for c, t in zip(rel.columns, rel.types)}
        d_rows = rel.fetchall()
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"cols spark-only={sorted(set(s_cols) - set(d_cols))} "
                            f"duck-only={sorted(set(d_cols) - set(s_cols))}")
        else:
            diff = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
            if diff:
                problems.append(f"types {diff}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        elif not problems and digest(s_cols, s_rows) != digest(d_cols, d_rows):
            problems.append("values differ")
            _show_diff(s_cols, s_rows, d_cols, d_rows)
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {key:32s} rows={len(s_rows):6d} {t1 - t0:.2f}s {'; '.join(problems)}")
    print(f"{'all ok' if not bad else f'{bad} mismatches'}")
    spark.stop()
    return 1 if bad else 0


def _show_diff(s_cols, s_rows, d_cols, d_rows, n=3):
    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    s_set = {repr(tuple(_norm(r[i]) for i in order_s)) for r in s_rows}
    d_set = {repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows}
    names = [s_cols[i] for i in order_s]
    print("   columns:", names)
    for x in sorted(s_set - d_set)[:n]:
        print("   spark-only:", x)
    for x in sorted(d_set - s_set)[:n]:
        print("   duck-only: ", x)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
