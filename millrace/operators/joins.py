"""Joins from a list of sources and predicates, with optional sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """A predicate over two or more sources. ``optional`` names the source on the side that may be missing; none means an inner join.

    ``spread`` is for an optional source that meets few keys with many rows each on both sides, so that the result has far more rows than the sides: it names
    the key's columns among the sources joined before (``"n.key"``), and the join is spread over tasks by shares of those sources' rows."""

    sources: tuple[str, ...]
    on: Column
    optional: str | None = None
    spread: tuple[str, ...] = ()


def join_graph(sources: dict[str, DataFrame], edges: Sequence[Edge] = (), filters: dict[str, Column] | None = None) -> DataFrame:
    """Join named sources as the dialect does; columns are addressed as ``name.column``.

    - ``filters`` of one source run before any join, so on an optional source they hold as ON conditions and don't remove rows.
    - A source that an edge marks optional is left joined; whatever inner edges tie to it belongs to its group: the group is
      joined first and is missing as a whole, ``t1 LEFT JOIN (t2 JOIN t3)``.
    - A source that is required by one edge and optional by another is an error. Sources without an edge are crossed.

    Which physical join is used, and its order within inner joins, is up to Catalyst.
    """
    frames = {name: (df.alias(name).where(filters[name]) if filters and name in filters else df.alias(name)) for name, df in sources.items()}
    for e in edges:
        if e.optional and e.optional not in e.sources or any(s not in frames for s in e.sources):
            raise ValueError(f"edge over unknown sources: {e.sources}")
    optional = {e.optional for e in edges if e.optional}
    root = {n for n in frames if n not in optional}
    group = {n: n for n in optional}
    changed = True
    while changed:  # inner edges pull sources into an optional one's group, unless they also tie to a required one
        changed = False
        for e in edges:
            if e.optional:
                continue
            owners = {group[s] for s in e.sources if s in group}
            free = [s for s in e.sources if s not in group]
            if len(owners) == 1 and free and not any(_pinned(s, edges, optional, group) for s in free):
                for s in free:
                    group[s], changed = owners.copy().pop(), True
                    root.discard(s)
    for e in edges:
        if not e.optional and any(s in group for s in e.sources) and any(s in root for s in e.sources):
            raise ValueError(f"{e.sources}: a source can't be both required and optional")

    def build(members: set[str], inner: list[Edge]) -> DataFrame:
        order = [n for n in frames if n in members]
        out, have, left = frames[order[0]], {order[0]}, list(inner)
        todo = order[1:]
        while todo:
            tied = next((n for n in todo if any(n in e.sources and set(e.sources) <= have | {n} for e in left)), todo[0])
            todo.remove(tied)
            have.add(tied)
            on = [e for e in left if set(e.sources) <= have]
            left = [e for e in left if e not in on]
            condition = _all([e.on for e in on])
            out = out.join(frames[tied], condition, "inner") if condition is not None else out.crossJoin(frames[tied])
        condition = _all([e.on for e in left])
        return out if condition is None else out.where(condition)

    inside = lambda members: [e for e in edges if not e.optional and set(e.sources) <= members]
    out, have = build(root, inside(root)), set(root)
    waiting = [n for n in frames if n in optional]
    while waiting:
        ready = next((n for n in waiting if all(set(e.sources) - {n} <= have for e in edges if e.optional == n)), None)
        if ready is None:
            raise ValueError(f"circular optional sources: {waiting}")
        members = {s for s, g in group.items() if g == ready}
        tying = [e for e in edges if e.optional == ready]
        keys = [k for e in tying for k in e.spread]
        right, on = build(members, inside(members)), _all([e.on for e in tying])
        out = _spread_join(out, right, on, keys) if keys else out.join(right, on, "left")
        have |= members
        waiting.remove(ready)
    return out


#: Rows on the left to a share of a spread join.
SHARE = 1 << 10


def _spread_join(left: DataFrame, right: DataFrame, on: Column, keys: Sequence[str]) -> DataFrame:
    """A left join in shares. The rows of left are counted (a job while the plan is built) and dealt out evenly, at most about ``SHARE`` to a share, and right's rows
    are copied to every share; share and key together are the join's key. A task then has some keys of some shares, and there are as many more shares as there are
    more rows on the left: what a key yields within a share grows with right alone. Up to ``SHARE`` rows it is the plain join."""
    shares = -(-left.count() // SHARE)
    if shares <= 1:
        return left.join(right, on, "left")
    tasks = max(shares, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = left.repartition(shares).withColumn("__share", F.spark_partition_id()).repartition(tasks, *keys, "__share")
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(copies.hint("merge"), on & (F.col("__share") == F.col("__copy")), "left").drop("__share", "__copy")


def _pinned(source: str, edges: Sequence[Edge], optional: set, group: dict) -> bool:
    """Whether a source is tied by an inner edge to sources of which none is in an optional group (so it is required itself)."""
    return any(not e.optional and source in e.sources and not any(s in group for s in e.sources) for e in edges)


def _all(conditions: list[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def lateral_explode(outer: DataFrame, array: Column, name: str, keep_empty: bool = False) -> DataFrame:
    """A source that is computed from each outer row: its nested rows. Rows of outer without any go, or stay with ``keep_empty``."""
    return outer.withColumn(name, (F.explode_outer if keep_empty else F.explode)(array))


def lateral_path(outer: DataFrame, path: Column, sources: DataFrame, on: Column | None = None, keep_empty: bool = False, path_col: str = "__path") -> DataFrame:
    """A source whose path is computed from each outer row. ``sources`` has the rows of all paths that may come up with their path (as a catalog's
    ``wildcard`` returns them), so it is an equality join on the path; a path that isn't there gives no rows, or one of nulls with ``keep_empty``."""
    named = sources.withColumnRenamed(path_col, "__lateral_path")
    condition = path == F.col("__lateral_path")
    return outer.join(named, condition if on is None else condition & on, "left" if keep_empty else "inner").drop("__lateral_path")


def lateral_pages(outer: DataFrame, pages: DataFrame, on: Column, page_col: str = "page") -> DataFrame:
    """Paged sources: the pages of each outer row from 0 on, up to the first page number that is missing."""
    from pyspark.sql import Window as W

    keys = outer.columns
    both = outer.join(pages, on)
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(page_col)) - 1
    return both.withColumn("__rank", rank).where(F.col(page_col) == F.col("__rank")).drop("__rank")


def nonempty(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of left that have a partner in right, each once. The dialect stops at the first row without one, which depends on row order;
    here every row is judged by itself."""
    return left.join(right, on, "left_semi")


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Join each value to the intervals [low, high) that hold it, by buckets of ``width``.

    Intervals are copied to every bucket that they reach, values go to one, and the join is an equality on the bucket
    with the bounds checked after. So it is a hash or sort-merge join instead of a nested loop; choose a width about as long as an interval."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    held = right.withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    on = (F.col("l.__b") == F.col("r.__b")) & (F.col(f"l.{value}") >= F.col(f"r.{low}")) & (F.col(f"l.{value}") < F.col(f"r.{high}"))
    return left.withColumn("__b", bucket(value)).alias("l").join(held.alias("r"), on, how).drop("__b")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """For each left row the latest right row of the same keys at or before its time; one union and one window, no range join."""
    from pyspark.sql import Window as W

    tagged = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in columns], F.lit(False).alias("__hit"))
    other = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    before = W.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    packed = F.last(F.when(F.col("__hit"), F.struct(*[F.col(f"__{c}").alias(c) for c in columns])), ignorenulls=True).over(before)
    return both.withColumn("__m", packed).where("__side = 1").select(*left.columns, *[F.col("__m")[c].alias(c) for c in columns])
