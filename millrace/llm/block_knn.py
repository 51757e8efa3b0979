"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed in double precision.

Vectors are coded once, and only their int8 codes, scales and norms go to the tiles. A tile's distances lie within known bounds, so it passes on the
candidates that may be among a query's k nearest; heaps merge the tiles' bounds by query; the vectors of what is left are fetched, and the distances
between them decide.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm._common import checkpoint, join_small, ship

#: Candidates and queries to a tile; a tile's task holds these codes and blocks of its product matrix.
TILE_CANDIDATES, TILE_QUERIES, BLOCK = 8192, 4096, 256
#: So many products of int8 values add up exactly in single precision.
EXACT_DIMS = 1024
CODED = ["id", "h", "dim", "codes", "scale", "size", "error"]


def usable(vector: Column) -> Column:
    """Not null, not all zero (nor empty), and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and in units of the scale the norms of the coded vectors and of what the coding leaves out. Nothing is squared before it is
    scaled, so large and small components neither overflow nor vanish."""
    scale = np.abs(x).max(1) / 127.0
    safe = np.where(scale > 0, scale, 1.0)[:, None]
    codes = np.rint(x / safe).astype(np.int8)
    return codes, scale, np.sqrt((codes.astype(np.float64) ** 2).sum(1)), np.sqrt(((x / safe - codes) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer products of int8 rows, by single-precision tiles that are exact."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return out


def distance_bounds(q: tuple, x: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Between which bounds the distances of some coded queries and candidates lie, each (codes, scale, size, error)."""
    unit = max(q[1].max(initial=0.0), x[1].max(initial=0.0)) or 1.0
    s, t = (q[1] / unit)[:, None], (x[1] / unit)[None, :]
    n, m = s * q[2][:, None], t * x[2][None, :]
    near = np.sqrt(np.maximum(n**2 + m**2 - 2 * s * t * products(q[0], x[0]), 0))
    slack = s * q[3][:, None] + t * x[3][None, :] + 1e-6 * (n + m)  # the last part is for rounding in these lines
    with np.errstate(over="ignore"):
        return np.maximum(near - slack, 0) * unit, (near + slack) * unit


def tile_survivors(query_ids: np.ndarray, q: tuple, ids: np.ndarray, x: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, low, high): places and bounds of all that may be among the k nearest candidates in the tile. Queries aren't their own
    candidates."""
    found = []
    for top in range(0, len(query_ids), BLOCK):
        rows = slice(top, top + BLOCK)
        best = np.full((len(query_ids[rows]), k), np.inf)
        mine = []
        for left in range(0, len(ids), 16 * BLOCK):
            cols = slice(left, left + 16 * BLOCK)
            low, high = distance_bounds(tuple(a[rows] for a in q), tuple(a[cols] for a in x))
            own = query_ids[rows, None] == ids[None, cols]
            best = np.partition(np.concatenate([best, np.where(own, np.inf, high)], 1), k - 1, axis=1)[:, :k]
            i, j = np.nonzero((low <= best.max(1)[:, None]) & ~own)
            mine.append((top + i, left + j, low[i, j], high[i, j]))
        i, j, low, high = (np.concatenate(c) for c in zip(*mine))
        kept = low <= best.max(1)[i - top]
        found.append((i[kept], j[kept], low[kept], high[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


class Merge:
    """Of one query's candidates in order of their lower bounds: which may be among the k nearest of all. A heap has the k least upper bounds so far."""

    def __init__(self, k: int):
        self.k = k
        self.heap: list[float] = []

    def admits(self, low: float, high: float) -> bool:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, -high)
            return True
        if low > -self.heap[0]:
            return False
        heapq.heappushpop(self.heap, -high)
        return True


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows, by Euclidean distance, of each query row: (query_id, rank, vec_id, score), ties to the smaller id.

    Candidates and queries are dealt by a hash of the id into groups of bounded size, and each pair of a query
    group and a candidate group is one tile for one task: a block join of a stated query set with all rows. The result is exact: rows are left
    out only where the error bounds of the int8 codes prove them farther. Vectors are fetched for the rows that are left, some ten or twenty a query.

    Unusable vectors (null, empty, zero, with null or non-finite components) and rows without id take no part. Vectors of different
    lengths aren't compared. A repeated id counts once as a query, with the vector of the least hash, and each time as a candidate, but never for itself.
    Distances beyond the range of doubles are infinite and tie. Other columns aren't read; an empty table gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v"))
    total, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    c_groups, q_groups = max(1, -(-total // TILE_CANDIDATES)), max(1, -(-asked // TILE_QUERIES))

    def code(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                codes, scale, size, error = quantise(part.column("v").flatten().to_numpy().reshape(-1, dim))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "dim")), packed, pa.array(scale), pa.array(size), pa.array(error), part.column("asked")], names=[*CODED, "asked"])

    coded = rows.select("id", "h", F.size("v").alias("dim"), "v", F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(code, "id long, h long, dim int, codes binary, scale double, size double, error double, asked boolean")
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tile = ["dim", "qg", "cg"]
    candidates = coded.select(*CODED, deal(c_groups, 1).alias("cg"), every(q_groups).alias("qg"))
    heads = coded.where("asked").groupBy("id").agg(F.min_by(F.struct(*CODED[1:]), "h").alias("row")).select("id", "row.*")
    queries = heads.select(*CODED, deal(q_groups, 2).alias("qg"), every(c_groups).alias("cg"))

    def columns(t: pa.Table) -> tuple:
        dim = t.column("dim")[0].as_py()
        return (np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(-1, dim), *(t.column(c).to_numpy() for c in ("scale", "size", "error")))

    def join(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("low", pa.float64()), ("high", pa.float64()))})
        query_ids, ids = q.column("id").to_numpy(), c.column("id").to_numpy()
        i, j, low, high = tile_survivors(query_ids, columns(q), ids, columns(c), k)
        return pa.table({"query_id": query_ids[i], "id": ids[j], "h": c.column("h").to_numpy()[j], "low": low, "high": high})

    def merge(batches):
        query = best = None
        for batch in batches:
            kept = []
            for q, low, high in zip(*(batch.column(c).to_pylist() for c in ("query_id", "low", "high"))):
                if q != query:
                    query, best = q, Merge(k)
                kept.append(best.admits(low, high))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["query_id", "id", "h"])

    near = queries.groupBy(*tile).cogroup(candidates.groupBy(*tile)).applyInArrow(join, "query_id long, id long, h long, low double, high double")
    left = near.repartition("query_id").sortWithinPartitions("query_id", "low").mapInArrow(merge, "query_id long, id long, h long")
    left = checkpoint(left.distinct())
    held = join_small(rows.select("id", "h", "v"), checkpoint(left.select("id", "h").distinct()), ["id", "h"], "left_semi").groupBy("id", "h").agg(F.first("v").alias("v"), F.count(F.lit(1)).cast("int").alias("times"))
    asking = rows.where("asked").groupBy(F.col("id").alias("query_id")).agg(F.min_by("v", "h").alias("q"))
    square = F.zip_with("q", "v", lambda a, b: (a - b) * (a - b))
    score = F.sqrt(F.aggregate(square, F.lit(0.0), lambda total, x: total + x))  # in the order of the components
    pairs = left.join(held, ["id", "h"]).join(asking, "query_id").select("query_id", F.col("id").alias("vec_id"), score.alias("score"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB SQL, for op5's queries.
ORACLE = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
