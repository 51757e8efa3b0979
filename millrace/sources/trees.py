"""JSON and XML documents as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of objects as rows, or with ``lines`` one object a line; truth values become 0 and 1. Give a schema to save the pass that finds
    it. Only files of lines are read by several tasks; an array is one task's work, so large data should be in many files or in lines."""
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return df.select(*[F.col(f"`{c}`").cast("int").alias(c) if t == "boolean" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """An object of named objects as rows: (name, fields of ``value``). ``value`` is the DDL schema of one."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("name", "raw"))
    rows = parsed.where(F.trim("raw").startswith("{")).select("name", F.from_json("raw", value).alias("v"))
    return rows.select("name", "v.*")


def money_of(s: Column) -> Column:
    """``{wholepart, fractionpart}`` as MONEY."""
    return (s["wholepart"].cast("decimal(14,4)") + s["fractionpart"].cast("decimal(14,4)") / 10000).cast("decimal(14,4)")


def datetime_of(s: Column) -> Column:
    """``{year, month, day, hour, minute, second}`` as DATETIME; missing times are midnight."""
    part = lambda n: F.coalesce(s[n], F.lit(0))
    return F.make_timestamp_ntz(s["year"], s["month"], s["day"], part("hour"), part("minute"), part("second").cast("decimal(16,6)"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Elements of one name as rows; attributes keep their name without mark."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def flatten(df: DataFrame, columns: Sequence[str], keep_empty: bool = True) -> DataFrame:
    """Nested arrays of structs as joined rows, one after the other; their fields become ``array_field``."""
    for c in columns:
        df = df.withColumn(c, (F.explode_outer if keep_empty else F.explode)(c))
        inner = df.schema[c].dataType
        if isinstance(inner, T.StructType):
            df = df.select(*[x for x in df.columns if x != c], *[F.col(c)[f].alias(f"{c}_{f}") for f in inner.names])
    return df
