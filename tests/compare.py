"""Results of a query and of its SQL, brought to one form and compared."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = """
region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations
clicks sales sale_lines clients client_changes vendors items stamps
""".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return int(x) if isinstance(x, bool) else x


def rows(names: list[str], got) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, in words; '' if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first {a[:1]} and {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ; first {bad[0]}" if bad else ""
