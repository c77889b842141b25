"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.9g}"
    if v is None:
        return "null"
    return f"{type(v).__name__}:{v}" if isinstance(v, (bool, str)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(names)}\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    types = {c: t for c, t in df.dtypes}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    odd = [(c, t, duck_types[c]) for c, t in types.items() if pairs.get(t) != duck_types[c]]
    return f"ok {len(a)} rows" + (f" TYPES {odd}" if odd else "")


def main():
    from duelframe.plans import catalog
    from duelframe.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = catalog.queries(), catalog.oracle_sql()
    wanted = sys.argv[2:]
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, name, query, sqls[name], sf_dir)
            else:
                result = f"rows only: {len(query(spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001 - a report of everything
            result = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - t0:6.1f}s {result}", flush=True)
    extra = set(sqls) - set(queries)
    if extra:
        print("SQL without query:", extra)


if __name__ == "__main__":
    main()
