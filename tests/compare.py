"""Run registered queries next to their SQL: ``python tests/compare.py SF_DIR [key ...]``."""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


KINDS = {"bigint": "long", "hugeint": "decimal", "integer": "int", "varchar": "string",
         "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def compare(con, df, sql) -> tuple[bool, str]:
    """Equal column names, types and rows."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return False, f"columns {names} / {sorted(rel.columns)}"
    types = dict(df.dtypes)
    for column, kind in zip(rel.columns, rel.types):
        kind = str(kind).lower()
        ours = {"bigint": "long"}.get(types[column], types[column])
        if KINDS.get(kind, kind) != ours and not (kind.startswith("timestamp") and
                                                  ours.startswith("timestamp")):
            return False, f"type of {column}: {ours} / {kind}"
    ours = sorted(tuple(canonical(r[c]) for c in names) for r in df.collect())
    order = [rel.columns.index(c) for c in names]
    theirs = sorted(tuple(canonical(r[i]) for i in order) for r in rel.fetchall())
    if ours == theirs:
        return True, f"{len(ours)} rows"
    a, b = set(ours), set(theirs)
    only = [[v[:160] for v in r] for r in sorted(a - b)[:2]]
    miss = [[v[:160] for v in r] for r in sorted(b - a)[:2]]
    for x, y in zip(sorted(a - b), sorted(b - a)):
        for n, u, v in zip(names, x, y):
            if u != v:
                at = next((i for i, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v)))
                only.append(f"{n}@{at}: {u[max(0, at - 60):at + 60]!r} / {v[max(0, at - 60):at + 60]!r}")
        break
    return False, f"{len(ours)}/{len(theirs)} {names}\n   spark only {len(a - b)}: {only}\n   sql only {len(b - a)}: {miss}"


def main() -> None:
    from placesearch.session import build_session
    sf_dir, *keys = sys.argv[1:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    if keys and keys[0].startswith("@"):
        mod = importlib.import_module(f"placesearch.plans.{keys[0][1:]}")
        queries, oracle, keys = mod.QUERIES, mod.SQL, keys[1:]
    else:
        from placesearch.plans import catalog
        queries, oracle = catalog.queries(), catalog.oracle_sql()
    bad = []
    for key in keys or queries:
        began = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracle:
                ok, note = compare(con, df, oracle[key])
            else:
                ok, note = True, f"{df.count()} rows (no SQL) {df.dtypes}"
        except Exception as error:  # noqa: BLE001
            ok, note = False, str(error)[:900]
        if not ok:
            bad.append(key)
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - began:.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
