"""Folders, mail messages, and databases as rows."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, size, modified) of files; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


MAIL = "path string, message long, part int, sender string, recipient string, subject string, sent string, mime string, filename string, body string"


def read_mail(spark: SparkSession, path: str, mbox: bool = False) -> DataFrame:
    """Each part of each message as a row. An mbox file is cut into messages at its ``From `` lines while it is read, by all tasks that read a part of
    the file, so no row holds more than a message; ``message`` is a number that grows within a file."""
    if mbox:
        lines = spark.read.text(path, lineSep="\nFrom ").select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("message"), "value")
        raw = lines.select("path", "message", F.encode(F.regexp_replace("value", r"^(From )?[^\n]*\n", ""), "UTF-8").alias("content"))
    else:
        raw = spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("message"), "content")

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, number, content in frame.itertuples(index=False):
                m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                head = [None if m[h] is None else str(m[h]) for h in ("from", "to", "subject", "date")]
                for k, p in enumerate(x for x in m.walk() if not x.is_multipart()):
                    text = p.get_payload(decode=True) or b""
                    rows.append((where, number, k, *head, p.get_content_type(), p.get_filename(), text.decode(p.get_content_charset() or "utf-8", "replace")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MAIL.split(", ")])

    return raw.mapInPandas(parts, MAIL)


def read_table(spark: SparkSession, url: str, table: str, split_by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table over JDBC; Spark pushes filters, columns and limits down. ``split_by`` deals the scan over ``parts`` ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_by and bounds:
        reader = reader.option("partitionColumn", split_by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", parts: int = 16, **options: str) -> None:
    """Rows into a database table over JDBC, in at most ``parts`` connections."""
    df.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
