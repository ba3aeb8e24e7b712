"""Compare a Spark result with DuckDB's for the same tables, row by row, whatever the order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str:
    """What is unlike, as text; empty if nothing is."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(names, got.fetchall()), rows(df.columns, df.collect())
    if want == have:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only here {list((have - want).items())[:3]}; only there {list((want - have).items())[:3]}"
