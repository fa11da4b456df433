"""Runs the registered queries beside their SQL and reports where they differ.

    python tests/compare.py [sf] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = [tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(text, key=lambda r: tuple(x or "" for x in r))


# How the two engines name the same types.
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, make, sql: str | None) -> str:
    """'' where both agree, else what differs."""
    df = make(spark, sf_dir)
    names, got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    res = con.execute(sql)
    want_names, want = sorted_rows([c[0] for c in res.description], res.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    kinds = {c[0]: str(c[1]) for c in res.description}
    other = [(c, t, kinds[c]) for c, t in df.dtypes if SAME_TYPE.get(t) != kinds[c]]
    if other:
        return f"types {other}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    if not off:
        return ""
    cells = [(n, a, b) for n, a, b in zip(names, *off[0]) if a != b]
    return f"{len(off)} of {len(got)} rows differ, first: {off[0][0][:2]} {cells[:4]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, con = local_session(8), connect(sf_dir)
    made, sqls = queries(), oracle_sql()
    print("without SQL:", sorted(set(made) - set(sqls)), "unknown SQL:", sorted(set(sqls) - set(made)))
    bad = 0
    for name in sys.argv[2:] or made:
        t = time.time()
        try:
            diff = compare(spark, con, sf_dir, made[name], sqls.get(name))
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {name} {time.time() - t:.1f}s {diff}", flush=True)
    print("differing:", bad)
    spark.stop()
