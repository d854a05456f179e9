"""Run registered queries beside their DuckDB SQL and report differences.

usage: python tools/check_oracles.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleanery.catalog import fixtures, registry  # noqa: E402
from gleanery.session import local_session  # noqa: E402


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def duck(sf_dir):
    con = duckdb.connect()
    for name in fixtures.BASE_SCHEMAS:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "NOSQL", len(got), took, ""
    start = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    duck_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return "COLS", len(got), took, f"{sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return "ok", len(a), took, f"duck {duck_took:.1f}s" if duck_took > 2 else ""
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return "DIFF", len(a), took, f"{len(a)} vs {len(b)}\n   spark {str(only_a)[:900]}\n   duck  {str(only_b)[:900]}"


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = registry.load()
    bad = 0
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, str(exc)[:1500]
        bad += status not in ("ok", "NOSQL")
        print(f"{status:6s} {name:36s} rows={n:<8d} {took:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
