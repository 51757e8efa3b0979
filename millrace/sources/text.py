"""Delimited and fixed-width text by a column specification, with the dialect's rules for empty fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import types
from millrace.storage import checkpoint


@dataclass(frozen=True)
class Field:
    """A column of a file: its type by the dialect's name, and for fixed-width files its place from 1 and its width."""

    name: str
    type: str = "string"
    start: int = 0
    width: int = 0


def _value(raw: Column, field: Field, last_text: bool) -> Column:
    """A field's value: leading white space goes, an empty number or date is null, empty text stays empty; the last text column loses
    trailing spaces."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+", "")
    if field.type == "string":
        return F.rtrim(text) if last_text else text
    text = F.when(F.trim(text) != "", F.trim(text))
    if field.type == "datetime":
        return types.to_datetime(text)
    return types.convert(field.type, text)


def _typed(raw: DataFrame, fields: Sequence[Field], *more: Column | str) -> DataFrame:
    last = max((i for i, f in enumerate(fields) if f.type == "string"), default=-1)
    return raw.select(*[_value(F.col(f"c{i}"), f, i == last).alias(f.name) for i, f in enumerate(fields)], *more)


def _csv(spark: SparkSession, path: str, fields: Sequence[Field], header: bool, separator: str, two_quote_escape: bool) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(fields))])
    return spark.read.schema(schema).csv(path, header=header, sep=separator, escape='"' if two_quote_escape else "\\", emptyValue="", ignoreLeadingWhiteSpace=True, enforceSchema=True)


def read_delimited(spark: SparkSession, path: str, fields: Sequence[Field], header: bool = True, separator: str = ",", two_quote_escape: bool = False, row_id: str | None = None) -> DataFrame:
    """CSV and BCP files. Backslashes escape unless quotes are doubled. Compressed files are told by their ending. With ``row_id`` rows are numbered
    in file order, in a column of that name."""
    raw = _csv(spark, path, fields, header, separator, two_quote_escape)
    return _typed(raw, fields) if row_id is None else _in_file_order(_typed(raw, fields, *_place()), row_id)


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[Field], row_id: str | None = None) -> DataFrame:
    raw = spark.read.text(path).select(*[F.substring("value", f.start, f.width).alias(f"c{i}") for i, f in enumerate(fields)], F.col("_metadata"))
    return _typed(raw, fields) if row_id is None else _in_file_order(_typed(raw, fields, *_place()), row_id)


def _place() -> list[Column]:
    """Where a row stands: its file, the block of the file, and a number that grows within the block."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__m")]


def with_row_ids(df: DataFrame, name: str = "name") -> DataFrame:
    """Number the rows from 1 in the order of the partitions: a count for each partition, running offsets over those, no gathering of rows. Spark
    puts the blocks of several files in partitions by size; the readers' ``row_id`` keeps the order of the files."""
    held = checkpoint(df.withColumn("__m", F.monotonically_increasing_id())).withColumn("__p", F.shiftright("__m", 33))
    return _numbered(held, ["__p"], name, df.columns)


def _in_file_order(df: DataFrame, name: str) -> DataFrame:
    return _numbered(checkpoint(df), ["__file", "__block"], name, [c for c in df.columns if c not in ("__file", "__block", "__m")])


def _numbered(held: DataFrame, by: list[str], name: str, columns: list[str]) -> DataFrame:
    """``held`` is written, so that its numbers ``__m`` are the same in both scans; one row for each block is ordered in one task."""
    blocks = held.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    starts = blocks.select(*by, (F.sum("__n").over(W.orderBy(*by)) - F.col("__n") - F.col("__first")).alias("__shift"))
    return held.join(starts, by).select((F.col("__shift") + F.col("__m") + 1).alias(name), *columns)


def write_delimited(df: DataFrame, path: str, separator: str = ",", header: bool = True, mode: str = "append", compression: str = "none") -> None:
    """Datetimes and money as the readers take them; null is an empty field."""
    shown = df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])
    shown.write.mode(mode).csv(path, header=header, sep=separator, escape="\\", nullValue="", emptyValue="", compression=compression)


def read_many(spark: SparkSession, pattern: str, fields: Sequence[Field], **options) -> DataFrame:
    """All files that a pattern with ``*`` matches, with the path that each row is from."""
    raw = _csv(spark, pattern, fields, options.get("header", True), options.get("separator", ","), options.get("two_quote_escape", False))
    return _typed(raw, fields, F.col("_metadata.file_path").alias("path"))
