"""Order-free comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from sourceloom.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else a short report."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    want = rows(names, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return None
    extra, missing = got - want, want - got
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; only Spark ({sum(extra.values())}): {list(extra)[:3]}; "
        f"only SQL ({sum(missing.values())}): {list(missing)[:3]}"
    )
