"""Mixing sources to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm._common import WORD, checkpoint, id_hash

#: Documents to one run of ranks; also what one window partition holds, roughly, in the largest cell.
CELL_ROWS = 65_536


def size_bin(size):
    """The leading four bits of a size and their place: a monotone bin, eight to each power of two."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return (shift * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Words to take from each source: shares by weight, stopped at ``max_epochs`` times its size, the excess reshared.

    ``sizes``: one row a source (skey, source_size). With the sources in order of size / weight, those that
    reach the limit come first, so running sums give the fixed point of the resharing at once. The table has a row
    for each source, not for each document.
    """
    by_key = W.orderBy("skey")
    ranked = sizes.withColumn("rank", F.row_number().over(by_key))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("skey")
    ranked = ranked.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = W.orderBy(F.col("source_size") / F.col("weight"), "skey").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("all_size") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("left", left).withColumn("rest", rest)
    full = (max_epochs * F.col("source_size") * F.col("rest") <= F.col("left") * F.col("weight"))
    ranked = ranked.withColumn("full", full)
    share = F.max(F.when(~F.col("full"), F.struct(F.col("rest"), F.col("left")))).over(everything)
    ranked = ranked.withColumn("share", share)
    level = F.col("share.left").cast("double") / F.col("share.rest").cast("double")
    target = F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double")).otherwise(F.col("weight").cast("double") * level)
    return ranked.select("skey", "source_size", "weight", target.alias("target"), (F.pmod(F.col("rank") * 40503 + 12345, F.lit(65536)) / 65536.0).alias("offset"))


#: Columns of a mix.
MADE = ["size", "source_size", "target", "copies", "taken"]


def systematic_mix(docs: DataFrame, *, keep: Sequence[str] | None = None, **options) -> DataFrame:
    """The columns ``keep`` of each document (default: all of ``docs``) and size, source_size, target, copies and taken, as ``copies_of`` finds them.
    Columns of ``docs`` with these names are left out; ``expand`` returns them."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    return copies_of(docs, keep=kept, **options).select(*[F.col("row")[c].alias(c) for c in kept], *MADE)


def copies_of(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """How many copies of each document a mix takes.

    Each document of a source expects target / source_size copies. Within a source the documents stand in order of
    size (by bins, then by a hash); a prefix sum of the expected copies plus one offset for each source
    gives each document a stretch of the number line, and it is taken once for each integer that its stretch crosses.
    Ordering by size makes the sample stratified: the words taken differ from the target by a few documents at most.

    The prefix sum is a rank times a constant, and ranks come in two levels: counts by (source, bin, hash bucket), summed
    up in two small windows, and row numbers within a bucket. Buckets grow in number with the rows, so a source or a size
    that holds a third of all documents is dealt over many tasks.

    Returns ``row`` (a struct of the columns ``keep``; default: all) and size, source_size, target, copies, taken. A null text
    has size 0; null sources are one source, last in order; repeated rows are separate documents; an empty table gives none.
    """
    kept = docs.columns if keep is None else keep
    rows = docs.count()
    buckets = 1 + rows // cell_rows
    base = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(id_col).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("skey"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = base.withColumn("bin", size_bin(F.col("size"))).withColumn("bucket", F.floor(id_hash(F.col("key")) * buckets / F.lit(2147483648)))
    if text_col not in kept:
        base = checkpoint(base)  # slim rows; else each use would split the texts again

    cells = checkpoint(base.groupBy("skey", "bin", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    bins = cells.groupBy("skey", "bin").agg(F.sum("n").alias("bin_n"))
    bins = bins.withColumn("bin_start", F.sum("bin_n").over(W.partitionBy("skey").orderBy("bin")) - F.col("bin_n"))
    targets = source_targets(cells.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    starts = (
        cells.withColumn("start", F.sum("n").over(W.partitionBy("skey", "bin").orderBy("bucket")) - F.col("n"))
        .join(bins, ["skey", "bin"]).join(targets, "skey")
        .select("skey", "bin", "bucket", (F.col("bin_start") + F.col("start")).alias("start"), "source_size", "target", "offset")
    )
    ranked = base.withColumn("place", F.row_number().over(W.partitionBy("skey", "bin", "bucket").orderBy("size", "key")))
    out = ranked.join(starts, ["skey", "bin", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    upto = F.col("start") + F.col("place")
    copies = F.floor(F.col("offset") + upto.cast("double") * rate) - F.floor(F.col("offset") + (upto - 1).cast("double") * rate)
    copies = F.least(copies, F.lit(max_epochs)).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs``, with its columns as they are, as many times as ``copies_of`` says."""
    mixed = copies_of(docs, **options).where(F.col("copies") > 0)
    repeated = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])


#: The same in DuckDB SQL, with the parameters of op7.
ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce('=' || source, '~') AS skey, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
b2 AS (
  SELECT *, greatest(length(bin(size)) - 4, 0) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS bin,
    ((((((coalesce(doc_id, -1) % 2147483648) + 2147483648) % 2147483648) * 1103515245 + 12345) % 2147483648) * (1 + (SELECT count(*) FROM documents) // {CELL_ROWS})) // 2147483648 AS bucket
  FROM base),
srt AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY bin, bucket, size, doc_id) AS place FROM b2),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(skey)) AS rank, (row_number() OVER (ORDER BY encode(skey)) - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT - 3 * coalesce(sum(source_size) OVER w, 0)::BIGINT AS lft, sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT AS rest
  FROM s1 WINDOW w AS (ORDER BY source_size::DOUBLE / weight, encode(skey) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, 3 * source_size * rest <= lft * weight AS capped FROM s2),
s4 AS (SELECT *, (SELECT lft::DOUBLE / rest::DOUBLE FROM s3 WHERE NOT capped ORDER BY rest DESC LIMIT 1) AS level FROM s3),
s5 AS (SELECT skey, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * level END AS target, ((rank * 40503 + 12345) % 65536) / 65536.0::DOUBLE AS off FROM s4),
r AS (SELECT srt.doc_id, srt.size, s5.source_size, s5.target, s5.off, srt.place, CASE WHEN s5.source_size > 0 THEN s5.target / s5.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM srt JOIN s5 USING (skey))
SELECT doc_id, size, source_size, target,
  size * CAST(least(floor(off + place::DOUBLE * rate) - floor(off + (place - 1)::DOUBLE * rate), 3) AS BIGINT) AS taken
FROM r
"""
