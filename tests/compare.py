"""Run queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    if type(a) is not type(b):
        return False
    return a == b


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    got_cols = sorted(df.columns)
    got = [tuple(r[c] for c in got_cols) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want_cols = sorted(names)
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    pos = [names.index(c) for c in want_cols]
    want = [tuple(r[p] for p in pos) for r in res.fetchall()]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    out = []
    for g, w in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if not all(_same(a, b) for a, b in zip(g, w)):
            out.append(f"{got_cols}: {g} != {w}")
            if len(out) >= limit:
                break
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry_module
    from wayloom.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    qs, oracles = entry_module.queries(), entry_module.oracle_sql()
    for name in names or qs:
        start = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracles:
                diff = differences(df, con, oracles[name])
                state = "ok" if not diff else "DIFF " + " | ".join(diff)
                n = ""
            else:
                n, state = df.count(), "rows-only"
        except Exception as e:  # noqa: BLE001
            state, n = f"ERROR {type(e).__name__}: {str(e)[:1500]}", ""
        print(f"{name:28s} {time.time() - start:6.1f}s {state} {n}", flush=True)
