"""Side-by-side run of a Spark query and its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], out


def sort_key(row):
    return tuple((v is not None, kind(v) if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None when both agree; else what differs."""
    df = fn(spark, folder)
    sc, srows = table([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    dc, drows = table(rel.fetchall(), [d[0] for d in rel.description])
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} != {len(drows)}; spark {sorted(srows, key=sort_key)[:2]} duck {sorted(drows, key=sort_key)[:2]}"
    if not srows:
        return "both are empty"
    srows.sort(key=sort_key)
    drows.sort(key=sort_key)
    bad = 0
    first = None
    for a, b in zip(srows, drows):
        for c, x, y in zip(sc, a, b):
            same = x == y and kind(x) == kind(y)
            if not same:
                bad += 1
                first = first or f"{c}: {x!r} ({kind(x)}) != {y!r} ({kind(y)}); spark {a} duck {b}"
    return f"{bad} values differ, e.g. {first}" if bad else None
