"""Compare registered queries with their SQL in DuckDB: column names, types and values.

Usage: python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def _sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows])


KIND = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(rows), f"rows={len(rows)} {took:.1f}s (no SQL) {str(rows[:1])[:150]}"
    start = time.time()
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want_types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    sql_took = time.time() - start
    note = f"rows={len(rows)}/{len(want)} {took:.1f}s sql {sql_took:.1f}s"
    if sorted(cols) != sorted(want_cols):
        return False, f"{note} columns {sorted(cols)} vs {sorted(want_cols)}"
    types = {f.name: KIND.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema.fields}
    odd = {c: (types[c], want_types[c]) for c in cols if types[c] != want_types[c]}
    a, b = _sorted_rows(cols, rows), _sorted_rows(want_cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{note} {sorted(cols)}\n   spark {only_a}\n   duck  {only_b}"
    return True, note + (f" TYPES {odd}" if odd else "") + ("" if rows else " EMPTY")


def main(argv):
    from driftengine.session import local_session
    import __spark_entry__ as entry

    args = argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, note = compare(spark, name, fn, sql.get(name), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv)
