"""Run queries next to their SQL and report differences: python -m contract.compare [dir] [names]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from .bindings import TABLES


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, f"{round(float(v), 5) + 0.0:.5f}")
    return (3, str(v))


def differences(df, con, sql: str) -> tuple[int, str]:
    """Number of rows, and a description of the first difference (empty if none)."""
    cols = sorted(df.columns)
    mine = sorted(tuple(_key(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return len(mine), f"columns {cols} != {sorted(names)}"
    pos = [names.index(c) for c in cols]
    types = {names[i]: str(cur.description[i][1]) for i in range(len(names))}
    theirs = sorted(tuple(_key(r[p]) for p in pos) for r in cur.fetchall())
    if len(mine) != len(theirs):
        return len(mine), f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return len(mine), f"{dict(zip(cols, a))}\n   != {dict(zip(cols, b))}"
    short = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    off = {c: (t, types[c]) for c, t in df.dtypes if short.get(t, t) != types[c]}
    return len(mine), f"types {off}" if off else ""


def main() -> None:
    from standflow.session import local_session

    from .catalog import registry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_connection(sf_dir)
    bad = 0
    for name, (fn, sql) in registry().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                n, diff = df.count(), ""
            else:
                n, diff = differences(df, con, sql)
        except Exception as e:  # noqa: BLE001
            n, diff = -1, f"{type(e).__name__}: {str(e)[:600]}"
            con = duck_connection(sf_dir)  # an internal error ends the old one
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok':4} {name:32} {n:7} rows {time.time() - start:6.2f} s {diff}",
              flush=True)
    print(f"{bad} with differences")


if __name__ == "__main__":
    main()
