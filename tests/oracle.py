"""Side-by-side check of a registered query and its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(round(float(value), 9) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(cells, key=lambda r: tuple("" if c is None else "v" + c for c in r))


def kinds(columns, types):
    def kind(name: str) -> str:
        name = name.lower()
        for group, marks in {
            "int": ("bigint", "int", "long", "hugeint"),
            "float": ("double", "decimal", "float"),
            "text": ("string", "varchar"),
        }.items():
            if any(name.startswith(m) for m in marks):
                return group
        return name
    return {c: kind(t) for c, t in zip(columns, types)}


def compare(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} != {want[0]}"
    a, b = kinds(df.columns, [f.dataType.simpleString() for f in df.schema]), kinds(names, types)
    if len(want[1]) != len(got[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    diff = {c: (a[c], b[c]) for c in a if a[c] != b[c] and not {a[c], b[c]} <= {"timestamp", "timestamp_ntz"}}
    return f"types differ {diff}" if diff else None
