"""Insert, update, delete and upsert as functions from tables to tables. The result is written as a new table: no row is changed in place,
so no statement sees its own changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns by name; missing ones are null, others are an error."""
    extra = set(rows.columns) - set(target.columns)
    if extra:
        raise ValueError(f"the target has no columns {sorted(extra)}")
    kinds = dict(target.dtypes)
    rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns])
    return target.unionByName(rows, allowMissingColumns=True)


def insert_through(target: DataFrame, rows: DataFrame, equals: dict[str, object]) -> DataFrame:
    """INSERT through a query with ``WHERE column = value AND ...``: what the rows leave out or have null is set so that they meet the condition
    (its reverse evaluation). Rows that contradict it are inserted as they are, and the query doesn't show them."""
    kinds = dict(target.dtypes)
    for c, v in equals.items():
        value = (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast(kinds[c]), value) if c in rows.columns else value)
    return insert(target, rows)


def update(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """All values are computed from the row as it was; rows where the condition is null stay."""
    hit = F.coalesce(where, F.lit(False))
    kinds = dict(target.dtypes)
    return target.select(*[F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """Rows where the condition is null stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], values: dict[str, Column], order: Column) -> DataFrame:
    """INSERT ... ON DUPLICATE keys UPDATE SET.

    Rows whose keys the target lacks are inserted; all others update every target row with their keys. ``values`` are
    expressions over ``t.*`` (the target row) and ``s.*`` (the source row). Source rows with one new key in ``order``: the first is inserted, later
    ones are duplicates of it and update it, so the last one's values stay. A null key duplicates nothing.
    """
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    w = W.partitionBy(*keys).orderBy(order)
    ranked = rows.withColumn("__n", F.when(named, F.row_number().over(w)).otherwise(1))
    heads = ranked.where("__n = 1")
    last = ranked.where(named).groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in ranked.columns]), "__n").alias("__row")).select("__row.*")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    fresh = heads.alias("h").join(target.select(*keys).alias("k"), [F.col(f"h.{k}") == F.col(f"k.{k}") for k in keys], "left_anti").select(*[F.col(f"h.{c}") for c in rows.columns])
    now = insert(target.withColumn("__old", F.lit(True)), fresh.withColumn("__old", F.lit(False)))
    joined = now.alias("t").join(last.alias("s"), on, "left")
    hit = F.col("s.__n").isNotNull() & (F.col("t.__old") | (F.col("s.__n") > 1))
    kinds = dict(target.dtypes)
    return joined.select(*[F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}").alias(c) for c in target.columns])
