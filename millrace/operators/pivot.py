"""Entity-attribute-value tables as relational ones, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eav_pivot(eav: DataFrame, keys: Sequence[str], attribute: str, values: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One row for each entity. ``columns`` gives each attribute's type; its value is the first of the typed value columns that isn't null.
    An attribute that an entity lacks is null. One aggregation, and the attributes need no pass of their own."""
    value = F.coalesce(*[F.col(v).cast("string") for v in values])
    return eav.groupBy(*keys).agg(*[F.max(F.when(F.col(attribute) == a, value)).cast(t).alias(a) for a, t in columns.items()])


def eav_unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], attribute: str = "attr_name", value: str = "attr_value") -> DataFrame:
    """One row for each attribute that isn't null, the value as text."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(keys), list(columns), attribute, value).where(F.col(value).isNotNull())


def eav_write(eav: DataFrame, changes: DataFrame, keys: Sequence[str], attribute: str = "attr_name", value: str = "attr_value") -> DataFrame:
    """The table after writing through the pivot: ``changes`` has (keys, attribute, value); a null value deletes the attribute."""
    on = [*keys, attribute]
    kept = eav.join(changes.select(*on), on, "left_anti")
    return kept.unionByName(changes.where(F.col(value).isNotNull()).select(*eav.columns))
