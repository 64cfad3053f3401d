"""Compare Spark queries with their DuckDB SQL: same columns, same rows in any order."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if they agree, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only Spark: {list((ours - theirs).items())[:3]}; only SQL: {list((theirs - ours).items())[:3]}"
