"""What reports compute: running aggregates and queries that are nested or side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import windows


def running(df: DataFrame, order: Sequence[Column], aggregates: dict[str, tuple[str, Column, Column | None]], by: Sequence[Column] = ()) -> DataFrame:
    """Running aggregates: name to (sum, count, avg, min or max; value; condition or none). ``by`` restarts them and deals the work."""
    w = (W.partitionBy(*by) if by else W).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    functions = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    return df.withColumns({n: functions[f](x if c is None else F.when(c, x)).over(w) for n, (f, x, c) in aggregates.items()})


def nested(outer: DataFrame, inner: DataFrame, on: Column, keep_outer: bool = True) -> DataFrame:
    """Inner rows under their outer row; outer rows without any stay."""
    return outer.join(inner, on, "left" if keep_outer else "inner")


def parallel(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Rows of two queries side by side, n-th with n-th; the shorter one is filled with nulls. Both are numbered by sorted ranges and joined by number."""
    return windows.number(left, left_order, "row_no").join(windows.number(right, right_order, "row_no"), "row_no", "full")


def multinested(levels: Sequence[tuple[DataFrame, Column | None]]) -> DataFrame:
    """Any number of queries, each nested in the one before: (rows, condition over the columns so far); the first has none. Rows without
    inner ones stay."""
    out = levels[0][0]
    for inner, on in levels[1:]:
        out = nested(out, inner, on)
    return out


def chart_series(df: DataFrame, x: str, legend: str, value: Column, series: Sequence | None = None) -> DataFrame:
    """A chart's series as columns."""
    return df.groupBy(x).pivot(legend, list(series) if series is not None else None).agg(value)
