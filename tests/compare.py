"""Results of Spark and DuckDB as comparable rows."""

import datetime
from decimal import Decimal


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float | Decimal):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def of_duck(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
