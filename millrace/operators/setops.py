"""Set operations and other extensions over the dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*a.columns)).distinct()


def exists(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b, on, "left_semi")


def in_query(x: Column, rows: DataFrame, column: str) -> Column:
    """IN (subquery): true, false or null as the dialect has it (null for a null left side; nulls in the subquery match nothing). As a filter,
    Catalyst makes a semi join of it."""
    held = rows.where(F.col(column).isNotNull()).select(column)
    return F.when(x.isNotNull(), x.isin(held))


def not_exists(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b, on, "left_anti")
