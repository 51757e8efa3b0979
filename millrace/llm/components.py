"""Connected components of a table of links, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import checkpoint

#: So many links, which are counted first, are kept in one partition (some megabytes), so that no step shuffles them; more are dealt over the cluster.
SMALL = 200_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component) for each node of the links; the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then its smaller
    neighbours and itself. Trees of links become stars in a number of rounds that grows with the log of the
    longest path. Each round is cut off by a checkpoint. Hubs are met by grouped minimums (partial aggregation) and joins that AQE
    may split. Links of a node with itself and repeated links are harmless; no links give no nodes.
    """
    edges = checkpoint(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(edges)
    few = state[0] <= small
    edges = _held(edges, few)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while state[0]:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = _held(checkpoint(_held(smaller.where("u <> v"), few).distinct()), few)
        new = _state(edges)
        if new == state:
            break
        state = new
    return nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _held(df: DataFrame, few: bool) -> DataFrame:
    return df.coalesce(1) if few else df


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
