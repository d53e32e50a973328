"""Runs a query and its SQL side by side: python -m tests.oracle SF NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(round(value, 9) + 0.0))
    if isinstance(value, (list, tuple)):
        return (1, repr([norm(x) for x in value]))
    if isinstance(value, bool):
        return (1, repr(value))
    return (1, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir):
    """None if both give the same columns and rows, else what differs; and the number of rows."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"create view {t} as select * from read_parquet('{path if path.is_file() else f'{path}/*.parquet'}')")
    got = con.execute(sql)
    want = rows_of([d[0] for d in got.description], got.fetchall())
    if mine[0] != want[0]:
        return f"columns {mine[0]} and {want[0]}", len(mine[1])
    if mine[1] != want[1]:
        only = [r for r in mine[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(mine[1])][:2]
        return f"{len(mine[1])} and {len(want[1])} rows; only here {only[0]}; only in SQL {only[1]}", len(mine[1])
    return None, len(mine[1])


def main() -> None:
    import __spark_entry__ as entry
    from loomrow.session import local_session

    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir("/tmp/oracle-checkpoints")
    sf, names = sys.argv[1], sys.argv[2:]
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or sql:
        began = time.time()
        if name not in sql:
            df = queries[name](spark, f"/root/testdata/{sf}")
            print(name, "rows only", df.count(), f"{time.time() - began:.1f}s", flush=True)
            continue
        try:
            why, n = compare(spark, queries[name], sql[name], f"/root/testdata/{sf}")
        except Exception as e:
            why, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        print(name, "ok" if why is None else f"DIFFERS {why}", n, f"{time.time() - began:.1f}s", flush=True)


if __name__ == "__main__":
    main()
