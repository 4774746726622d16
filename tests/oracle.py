"""Hold registered queries against their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        at = Path(sf_dir, f"{name}.parquet")
        if at.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_norm(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, _norm(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return _norm(value.asDict())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """An empty text if both give the same rows."""
    began = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - began
    cur = connect(sf_dir).execute(sql)
    columns = [x[0] for x in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return f"{name}: {len(mine)} and {len(theirs)} rows; only here {[x[:300] for x in list(a - b)[:2]]}, only in SQL {[x[:300] for x in list(b - a)[:2]]}"
    print(f"{name}: {len(mine)} rows equal, {took:.1f} s", file=sys.stderr)
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from taxflow.session import local_session

    spark = local_session("oracle", shuffle_partitions=8)
    queries, sql = entry.queries(), entry.oracle_sql()
    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    for name in [a for a in sys.argv[1:] if not a.startswith("/")] or sorted(sql):
        if name in sql:
            try:
                print(differences(spark, sf, name, queries[name], sql[name]) or f"{name}: ok")
            except Exception as e:  # go on with the others
                print(f"{name}: {type(e).__name__} {str(e)[:600]}")
        else:
            began = time.time()
            got = queries[name](spark, sf).collect()
            print(f"{name}: {len(got)} rows, {time.time() - began:.1f} s, e.g. {str(got[:2])[:300]}")
