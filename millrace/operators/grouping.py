"""Grouping: ordered aggregates, columns of a group's last row, two levels, and the one-row rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count(x: Column) -> Column:
    return F.count(x)


def sum_(x: Column) -> Column:
    """Nulls are skipped; integers add up as 64 bits (the dialect's own 32 bits overflow)."""
    return F.sum(x)


def sum_text(x: Column, order: Column) -> Column:
    """``sum`` over strings: concatenation, in the given order; null if there is none."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("k"), x.alias("v"))))), lambda e: e["v"]), "")


def avg(x: Column, kind: str = "double") -> Column:
    """Of integers the quotient cut towards zero; of money with four places, cut; of doubles the mean."""
    if kind == "integer":
        return F.call_function("div", F.sum(x), F.count(x))
    if kind == "money":
        mean = F.sum(x.cast("decimal(14,4)")).cast("decimal(30,4)") * 10000 / F.count(x)
        return (F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean)).cast("decimal(30,0)") / 10000).cast("decimal(14,4)")
    return F.avg(x)


def first(x: Column, order: Column) -> Column:
    """The first value that isn't null, in the given order."""
    return F.min_by(x, F.when(x.isNotNull(), order))


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order))


def nth(x: Column, n: int, order: Column) -> Column:
    """The n-th value from 1 that isn't null; null if there are fewer. It gathers a group's values: meant for groups of modest size."""
    values = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("k"), x.alias("v")))))
    return F.get(values, F.lit(n - 1))["v"]


def nth_by_key(df: DataFrame, keys: Sequence[str], x: Column, n: int, order: Column, name: str) -> DataFrame:
    """The same as a table (keys, name) for groups of any size: each task keeps the n first rows of a key before the shuffle. Keys of fewer values
    are missing."""
    values = df.select(*keys, x.alias(name), order.alias("__o")).where(F.col(name).isNotNull())
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__o"))
    return values.withColumn("__n", place).where(F.col("__n") <= n).where(F.col("__n") == n).select(*keys, name)


def group(df: DataFrame, keys: Sequence[Column], aggregates: Sequence[Column] = (), last_row: Sequence[str] = (), order: Column | None = None, having: Column | None = None, one_row: bool = False) -> DataFrame:
    """GROUP BY. ``last_row`` columns take their value from the group's last row by ``order`` (which should be unique).

    Without aggregates it is the dialect's way to say DISTINCT. ``one_row``: as in the dialect, an empty input gives one row even with
    keys, of nulls and empty aggregates. All partial: no group is gathered in one row."""
    packed = [F.max_by(F.struct(*last_row), order).alias("__last")] if last_row else []
    out = df.groupBy(*keys).agg(*aggregates, *packed) if aggregates or packed else df.select(*keys).distinct()
    if last_row:
        out = out.select(*[c for c in out.columns if c != "__last"], *[F.col("__last")[c].alias(c) for c in last_row])
    if one_row and keys:
        empty = df.agg(*aggregates, *packed) if aggregates or packed else df.agg(F.count(F.lit(1)).alias("__n"))
        empty = empty.join(out.limit(1).select(F.lit(1).alias("__some")), F.lit(True), "left").where("__some is null")
        names = [c for c in out.columns]
        kinds = dict(out.dtypes)
        out = out.unionByName(empty.select(*[(F.col(c) if c in empty.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]))
    return out.where(having) if having is not None else out


def two_level(df: DataFrame, keys: Sequence[Column], inner: Sequence[Column], outer: Sequence[Column]) -> DataFrame:
    """``sum(sum(x))``: aggregates of the groups' aggregates, in one row."""
    return df.groupBy(*keys).agg(*inner).agg(*outer)


def crosstab(df: DataFrame, keys: Sequence[str], by: str, value: Column, values: Sequence | None = None) -> DataFrame:
    """One column for each value of ``by``; give ``values`` to save the pass that finds them."""
    return df.groupBy(*keys).pivot(by, list(values) if values is not None else None).agg(value)
