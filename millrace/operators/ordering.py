"""Sorting and limits. Nulls come first in either direction; equal rows are told apart by a tie breaker that the caller gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """Keys like ``"a"`` and ``"a desc"``."""
    out = []
    for k in keys:
        name, _, way = k.partition(" ")
        out.append(F.col(name).desc_nulls_first() if way.strip().lower() == "desc" else F.col(name).asc_nulls_first())
    return df.orderBy(*out)


def limit(df: DataFrame, start: int, count: int | None = None) -> DataFrame:
    """``limit(df, n)`` or ``limit(df, start, count)``, start from 0. On a sorted frame Spark keeps only that many rows per task."""
    return df.limit(start) if count is None else df.offset(start).limit(count)


def select_rows(df: DataFrame, where=None, select=None, having=None, rowcount: int | None = None, offset: int = 0, count: int | None = None) -> DataFrame:
    """The dialect's order of steps: WHERE, columns, SET ROWCOUNT, HAVING over the output, LIMIT."""
    if where is not None:
        df = df.where(where)
    if select is not None:
        df = df.select(*select)
    if rowcount is not None:
        df = df.limit(rowcount)
    if having is not None:
        df = df.where(having)
    return df if count is None else df.offset(offset).limit(count)
