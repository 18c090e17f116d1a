"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py <data dir> [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(df, con, sql: str) -> str:
    """Empty when names, row count and every value agree."""
    got_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = _rows(df.columns, got_rows), _rows(names, want_rows)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    kinds = [tuple(type(x).__name__ for x in r) for r in (got[:1] + want[:1])]
    return "" if len(set(kinds)) <= 1 else f"types {kinds}"


def main(path: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from cohortwarn.session import local_session

    spark = local_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(path), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, path)
            sql = entry.oracle_sql().get(name)
            note = differences(df, con, sql) if sql else f"(no SQL) {df.count()} rows"
            bad = bool(note) and sql is not None
        except Exception as e:  # report and go on
            note, bad = f"{type(e).__name__}: {str(e)[:400]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
