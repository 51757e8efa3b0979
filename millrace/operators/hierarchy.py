"""Trees in parent-child tables: subtree scans, inheritance, and views of trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import checkpoint


def subtree(nodes: DataFrame, root: Column, id_col: str = "id", parent_col: str = "parent", name_col: str = "name", where: Column | None = None, inclusive: bool = False, pruned: bool = False, max_depth: int = 64) -> DataFrame:
    """All nodes below the roots, with their path, parent's path, parent's name and depth (from 1; the root itself has 0).

    One join for each level, until a level is empty or ``max_depth`` is reached: a level is a set of rows in the cluster, never a loop over nodes.
    ``where`` chooses the rows returned; with ``pruned`` nothing below a chosen row is visited. ``inclusive`` returns the root too.
    """
    columns = nodes.columns
    picked = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    top = nodes.where(root).select("*", F.concat(F.lit("/"), F.col(name_col).cast("string")).alias("__path"), F.lit(None).cast("string").alias("__parentpath"), F.lit(None).cast("string").alias("__parentname"), F.lit(0).alias("__depth"))
    out = top if inclusive else top.limit(0)
    level = top
    for depth in range(1, max_depth + 1):
        above = level.where(~picked) if pruned and (depth > 1 or inclusive) else level
        above = above.select(F.col(id_col).alias("__id"), F.col("__path").alias("__pp"), F.col(name_col).cast("string").alias("__pn"))
        level = nodes.join(above, F.col(parent_col) == F.col("__id")).select(*columns, F.concat("__pp", F.lit("/"), F.col(name_col).cast("string")).alias("__path"), F.col("__pp").alias("__parentpath"), F.col("__pn").alias("__parentname"), F.lit(depth).alias("__depth"))
        level = checkpoint(level)  # else each level would run all joins above it again
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.where(picked)


def inherit(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, columns: Sequence[str]) -> DataFrame:
    """Attributes that a child lacks come from its parent."""
    p = parent.select(F.col(parent_key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = child.join(p, F.col(child_key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in child.columns])


def tree_view(levels: Sequence[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """A tree of views: each level is (rows, name column, column that names the parent in the level above). Returns depth, path and name of all rows."""
    out, above = None, None
    for depth, (rows, name, parent) in enumerate(levels, 1):
        rows = rows.select(F.col(name).cast("string").alias("name"), *([F.col(parent).cast("string").alias("__up")] if parent else []))
        if above is None:
            here = rows.select(F.lit(depth).alias("depth"), F.concat(F.lit("/"), "name").alias("path"), "name")
        else:
            up = above.select(F.col("name").alias("__n"), F.col("path").alias("__p"))
            here = rows.join(up, F.col("__up") == F.col("__n")).select(F.lit(depth).alias("depth"), F.concat("__p", F.lit("/"), "name").alias("path"), "name")
        out = here if out is None else out.unionByName(here)
        above = here
    return out
