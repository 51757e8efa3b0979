"""Window functions over the order of rows, which restart where keys change.

The dialect has no PARTITION BY: its functions run over the rows as they come, and keys restart them when they differ from the row
before. ``by`` splits the rows into independent sequences. Without it rows are numbered by sorted ranges, so that no task sees them all; only
``lag`` over a whole table is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.storage import checkpoint


def _window(order: Sequence[Column], by: Sequence[Column] = ()):
    return W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)


def runs(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], name: str = "run", by: Sequence[Column] = ()) -> DataFrame:
    """Number the runs of rows with equal keys, from 1. Nulls equal each other."""
    if not by:
        return _runs_of_all(df, keys, order, name)
    w = _window(order, by)
    same = F.lit(True)
    for k in keys:
        same = same & k.eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first | ~same, 1).otherwise(0)).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__new")


def number(df: DataFrame, order: Sequence[Column], name: str = "row_number", start: int = 1) -> DataFrame:
    """A running number over all rows, without gathering them: rows are sorted by ranges and written once, then each partition gets its offset from
    the counts of those before it (one row a partition)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = checkpoint(sorted_.withColumn("__m", F.monotonically_increasing_id())).withColumn("__p", F.shiftright("__m", 33))
    sizes = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(F.col("__p").alias("__q"), (F.sum("__n").over(W.orderBy("__p")) - F.col("__n") + start).alias("__start"))
    numbered = held.join(starts, F.col("__p") == F.col("__q"))
    return numbered.select(*df.columns, (F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias(name))


#: Rows to one window of ``runs`` over a whole table.
STRETCH = 1 << 20


def _runs_of_all(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """``runs`` without ``by``: numbered rows in stretches; each stretch gets the last row before it and the number of runs begun before it."""
    packed = checkpoint(number(df.withColumn("__k", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])), order, "__r", 0)).withColumn("__s", F.floor(F.col("__r") / STRETCH))
    ends = packed.groupBy("__s").agg(F.max_by(F.struct("__k"), "__r").alias("__last")).select((F.col("__s") + 1).alias("__t"), F.col("__last.__k").alias("__before"))
    w = W.partitionBy("__s").orderBy("__r")
    before = F.when(F.col("__r") % STRETCH == 0, F.col("__before")).otherwise(F.lag("__k").over(w))
    marked = packed.join(ends, F.col("__s") == F.col("__t"), "left").withColumn("__new", F.when((F.col("__r") > 0) & before.eqNullSafe(F.col("__k")), 0).otherwise(1))
    begun = marked.groupBy("__s").agg(F.sum("__new").alias("__n"))
    begun = begun.select(F.col("__s").alias("__u"), (F.sum("__n").over(W.orderBy("__s")) - F.col("__n")).alias("__begun"))
    run = F.col("__begun") + F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.join(begun, F.col("__s") == F.col("__u")).withColumn(name, run).select(*df.columns, name)


def row_number(df: DataFrame, order: Sequence[Column], keys: Sequence[Column] = (), name: str = "row_number", by: Sequence[Column] = ()) -> DataFrame:
    """Running number; with keys it restarts at each run of them."""
    if not keys:
        return df.withColumn(name, F.row_number().over(_window(order, by))) if by else number(df, order, name)
    numbered = runs(df, keys, order, "__run", by)
    return numbered.withColumn(name, F.row_number().over(W.partitionBy(*by, F.col("__run")).orderBy(*order))).drop("__run")


def row_number_sorted(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """The same where the rows are sorted by the keys first: runs are groups, so it is dealt over tasks by key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def dense_rank(df: DataFrame, order: Sequence[Column], keys: Sequence[Column] = (), name: str = "dense_rank", by: Sequence[Column] = ()) -> DataFrame:
    """Constant 1 without keys, else the number of the run."""
    return runs(df, keys, order, name, by) if keys else df.withColumn(name, F.lit(1))


def lag(x: Column, order: Sequence[Column], n: int = 1, by: Sequence[Column] = ()) -> Column:
    """The value n rows before."""
    return F.lag(x, n).over(_window(order, by))
