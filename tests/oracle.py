"""Rows of a query and of its SQL in a form that can be compared."""

import datetime
import decimal
import math
from pathlib import Path


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None).isoformat() if v.tzinfo else v.isoformat()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else float(f"{v:.9g}")
    return v


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def both(spark, con, folder: str, query, sql: str):
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(sql)
    theirs_names = [x[0] for x in result.description]
    assert sorted(theirs_names) == names
    theirs = sorted((tuple(plain(r[theirs_names.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    return ours, theirs
