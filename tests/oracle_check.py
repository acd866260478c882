"""Run registered queries next to their SQL: python tests/oracle_check.py SF [names...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(keyed, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def kind(t: str) -> str:
    t = t.lower()
    for family, names in {"int": ("int", "long", "short"), "float": ("double", "float"), "text": ("string", "varchar"),
                          "bool": ("bool",), "time": ("timestamp",), "date": ("date",)}.items():
        if any(n in t for n in names):
            return family
    return t


def compare(spark, con, name, query, sql, folder):
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got), took, ""
    start = time.time()
    rel = con.execute(sql)
    want = rel.fetchall()
    names = [d[0] for d in rel.description]
    types = {d[0]: kind(str(d[1])) for d in rel.description}
    a, x = rows_of(df.columns, got)
    b, y = rows_of(names, want)
    if a != b:
        return "COLUMNS", len(got), took, f"{set(a) ^ set(b)}"
    note = "; ".join(f"{f.name}: {kind(f.dataType.simpleString())} vs {types[f.name]}" for f in df.schema
                     if kind(f.dataType.simpleString()) != types[f.name])
    if len(x) != len(y):
        return "COUNT", len(got), took, f"{len(x)} vs {len(y)} {note}"
    if not x:
        return "EMPTY", 0, took, note
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    if bad:
        p, q = bad[0]
        diff = [(c, u, v) for c, u, v in zip(a, p, q) if u != v]
        return "VALUES", len(got), took, f"{len(bad)} rows differ, first: {diff} {note}"
    return ("TYPES" if note else "ok"), len(got), took, note


def main():
    from contentgauge.session import local_session
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session(os.environ.get("CPUS", "8"))
    spark.sparkContext.setLogLevel("FATAL")
    con, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[2:] or any(q.startswith(p) for p in sys.argv[2:])]
    failed = []
    for name in wanted:
        try:
            status, n, took, note = compare(spark, con, name, queries[name], oracle.get(name), folder)
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, str(e).split("JVM stacktrace")[0][:600]
        if status not in ("ok", "rows-only"):
            failed.append(name)
        print(f"{name:36} {status:9} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} fine; failed: {failed}")


if __name__ == "__main__":
    main()
