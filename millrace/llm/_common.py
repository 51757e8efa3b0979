"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import checkpoint as checkpoint

#: A word, everywhere in this subpackage: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches of texts hold at most so many rows and bytes, where the session has Spark's defaults (10,000 rows, 64 MB): a task holds a few at once.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}

#: A small table is broadcast up to this many rows and bytes; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
#: Longer labelled texts (in bytes) aren't fitted on.
LONGEST = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: bytes) -> list[bytes]:
    """The words of UTF-8 text; ``bytes.split`` cuts at exactly the white space that WORD excludes."""
    return text.split()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context, and keep their Arrow batches small."""
    sc = spark.sparkContext
    for key, (default, small) in ARROW.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)
    root = Path(__file__).resolve().parents[1]
    if getattr(sc, "_millrace_shipped", False) or not root.is_dir():
        return
    handle, name = tempfile.mkstemp(prefix="millrace-", suffix=".zip", dir=os.path.realpath(tempfile.gettempdir()))
    with os.fdopen(handle, "wb") as raw, zipfile.ZipFile(raw, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._millrace_shipped = True


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table that is usually small: broadcast after its rows and bytes are counted, else shuffled with AQE's skew handling. Null keys
    equal each other.

    ``small`` should be cheap to count (checkpointed)."""
    width = F.lit(0)
    for c in small.columns:
        width = width + 16 + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    n, total = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    named = small.withColumnsRenamed({c: f"__{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = big.join(F.broadcast(named) if n <= rows and total <= size else named, condition, how)
    return out.drop(*(f"__{c}" for c in on))


def id_hash(column: Column, salt: int = 0) -> Column:
    """A 31-bit hash of an integer column in plain arithmetic, so that any SQL engine can repeat it."""
    x = F.pmod(F.coalesce(column.cast("long"), F.lit(-1)), F.lit(2147483648))
    return F.pmod(x * F.lit(1103515245) + F.lit(12345 + 7919 * salt), F.lit(2147483648))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> list[tuple[int, str, int]]:
    """At most ``limit`` labelled documents for fitting, the same ones at each run: the smallest by a hash of the id, without texts of more than LONGEST
    bytes. If an id has several texts, the least one counts.

    The ids are bounded by ``limit``, so they are broadcast to a scan of the documents; at most ``limit`` texts of bounded length come to the driver."""
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(target).alias("label"))
        .orderBy(id_hash(F.col("doc_id")), "doc_id").limit(limit)
    )
    ids = {r[0]: r[1] for r in chosen.collect()}
    if not ids:
        return []
    frame = docs.sparkSession.createDataFrame([(int(k), int(v)) for k, v in ids.items()], "doc_id long, label int")
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST)
    found = texts.join(F.broadcast(frame), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["text"], r["label"]) for r in found.collect())
