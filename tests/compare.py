"""Runs registered queries next to their SQL in DuckDB and compares the rows as multisets."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = f"{name}: spark {t1 - t0:.1f}s ({len(got)} rows), sql {t2 - t1:.1f}s ({len(want)} rows)"
    if sorted(names) != sorted(df.columns):
        return False, f"{info} columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        return False, f"{info} only spark {list((a - b).items())[:3]} only sql {list((b - a).items())[:3]}"
    kinds = {type(v) for r in got[:50] for v in r} - {type(None)}
    if not kinds <= {str, int, float, bool}:
        return False, f"{info} nested values {kinds}"
    return True, info


if __name__ == "__main__":  # python tests/compare.py [sf_dir] [names...]
    import __spark_entry__ as entry
    from lexispark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    connection, oracles = duck(sf), entry.oracle_sql()
    bad = []
    for key, run in entry.queries().items():
        if sys.argv[2:] and not any(key == n or (n.endswith("*") and key.startswith(n[:-1])) for n in sys.argv[2:]):
            continue
        try:
            if key in oracles:
                ok, text = compare(session, connection, key, run, oracles[key], sf)
            else:
                start = time.time()
                ok, text = True, f"{key}: rows only, {len(run(session, sf).collect())} rows"
                text += f", {time.time() - start:.1f}s"
        except Exception as e:  # noqa: BLE001
            connection = duck(sf)  # a fatal error invalidates the old one
            ok, text = False, f"{key}: {type(e).__name__} {str(e)[:600]}"
        print("ok  " if ok else "FAIL", text, flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad)
