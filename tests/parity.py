"""Compare registered queries with their SQL on one scale: ``python tests/parity.py sf0.001 [names]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KIND = {"int": "whole", "bigint": "whole", "smallint": "whole", "tinyint": "whole", "double": "real", "string": "text", "boolean": "flag",
        "INTEGER": "whole", "BIGINT": "whole", "DOUBLE": "real", "VARCHAR": "text", "BOOLEAN": "flag"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, con, folder, work, sql) -> str:
    """Empty when both sides agree, else what differs."""
    got = work(spark, folder)
    rel = con.sql(sql)
    mine = {n: KIND.get(t, t) for n, t in got.dtypes}
    theirs = {n: KIND.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    if mine != theirs:
        return f"schema {mine} <> {theirs}"
    names = sorted(mine)
    def clean(v):
        return None if v is None else (repr(float(v) + 0.0) if isinstance(v, float) else v)
    left = [tuple(clean(v) for v in r) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    right = [tuple(clean(v) for v in r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()]
    left.sort(key=repr)
    right.sort(key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} <> {len(right)}; e.g. {[r for r in left if r not in set(right)][:2]} / {[r for r in right if r not in set(left)][:2]}"
    bad = [(a, b) for a, b in zip(left, right) if [repr(x) for x in a] != [repr(x) for x in b] and not same(a, b)]
    return f"{len(bad)} of {len(left)} rows differ, {names}: {str(bad[0])[:700]}" if bad else ""


def same(a, b) -> bool:
    return all(x == y or (x is not None and y is not None and not isinstance(x, str) and float(x) == float(y)) for x, y in zip(a, b))


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from gridleaf.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{sys.argv[1]}"
    con = connect(folder)
    chosen = sys.argv[2:] or list(queries())
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            problem = compare(spark, con, folder, queries()[name], sql) if sql else "no oracle"
        except Exception as err:  # report and go on
            problem = f"ERROR {type(err).__name__} {str(err)[:900]}"
        failed += bool(problem)
        print(f"{name:22} {time.time() - start:5.1f}s {problem or 'ok'}", flush=True)
    print("failed:", failed, "of", len(chosen))
