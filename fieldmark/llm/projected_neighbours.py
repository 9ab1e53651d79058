"""Approximate nearest neighbours on low-dimensional stable projections (Sun, Wang, Qin, Zhang, Lin, "SRS: solving
c-approximate nearest neighbor queries in high dimensional Euclidean space with a tiny index", 2014).

Vectors are projected to `DIMENSIONS` Gaussian (2-stable) coordinates, indexed by a kd-tree.  A query takes
the tree's leaves by their distance in the projection and verifies their vectors on all coordinates.
The squared projected distance over the squared distance follows a chi-square law with `DIMENSIONS`
degrees of freedom, so once the projected distance of all that is left is r and the k-th best
distance is d, a vector closer than d is missed with a probability of 1 - chi2(r*r / d*d): the search
stops when chi2 passes `CONFIDENCE`.

Largest inner products become smallest distances by one more coordinate: with M the largest length of a
vector, v becomes (v, sqrt(M*M - |v|*|v|)) and a query q becomes (q, 0).

Vectors are dealt to blocks by a hash of vec_id; each block has its own tree and meets every block of
queries, and a query's best of all blocks are merged.  A block of queries is `QUERIES`, so the table is sent once for
that many queries.  Equal vectors of a block are one point with
the smallest ids that any query can need (k + 1), so copies neither unbalance the tree nor grow a leaf.

Defined results.  Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows with a null vec_id.  Vectors of different lengths have no inner product: a query's candidates are those of its own length.
Of rows that repeat a vec_id the one with the smallest vector (component by component) stands for it.  A query's own vec_id is no
candidate of it.  Ties go to the smaller vec_id.  A table without usable vectors gives no row.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Shelf

DIMENSIONS = 8
CONFIDENCE = 0.97
LEAF = 128
#: Vectors in a block of the index, and queries in a block of queries.
BLOCK, QUERIES = 16_384, 8_192


def chi2_cdf(x: np.ndarray | float, k: int) -> np.ndarray | float:
    """For an even number of degrees of freedom: 1 - exp(-x/2) * sum of (x/2)**j / j!."""
    half = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, k // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def stopping_ratio(confidence: float, k: int) -> float:
    """The r*r / d*d at which the chi-square law passes the confidence."""
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < confidence else (lo, mid)
    return hi


class Tree:
    """A kd-tree over projected points, kept as its leaves' row ranges and boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        ranges, waiting = [], [(0, len(points))]
        while waiting:
            a, b = waiting.pop()
            if b - a <= leaf:
                ranges.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            waiting += [(a, a + mid), (a + mid, b)]
        self.ranges = np.array(sorted(ranges))
        sorted_points = points[self.order]
        self.low = np.array([sorted_points[a:b].min(axis=0) for a, b in self.ranges])
        self.high = np.array([sorted_points[a:b].max(axis=0) for a, b in self.ranges])

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance from q, nearest first."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        bound = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(bound, kind="stable")
        return order, bound[order]


def _directions(width: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width + 1, dimensions))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = 7):
    """(query position, vec_id, score) of each query's best k in one block."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, first, copy = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).reshape(-1), return_index=True, return_inverse=True)
    copy = copy.reshape(-1)
    # ids of each distinct vector, smallest first; a query needs k of them besides itself
    by_copy = np.argsort(copy, kind="stable")
    cut = np.searchsorted(copy[by_copy], np.arange(len(first) + 1))
    points = vectors[first]
    lengths = np.einsum("ij,ij->i", points, points)
    extra = np.sqrt(np.maximum(longest - lengths, 0.0))
    directions = _directions(points.shape[1], dimensions, seed)
    projected = points @ directions[:-1] + extra[:, None] * directions[-1]
    tree = Tree(projected)
    # everything in the order of the leaves
    points, projected, lo, copies = points[tree.order], projected[tree.order], cut[:-1][tree.order], np.diff(cut)[tree.order]
    stop = stopping_ratio(confidence, dimensions)
    out_q, out_id, out_score = [], [], []
    for position, (qid, q, p) in enumerate(zip(query_ids.tolist(), queries, queries @ directions[:-1], strict=True)):
        leaves, bounds = tree.leaves(p)
        length = float(q @ q)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        best, at, step = np.zeros(0), 0, 4
        while at < len(leaves):
            reach = np.inf
            # one more than k: the query itself may be among them
            if len(best) > k:
                kth = np.partition(best, len(best) - k - 1)[len(best) - k - 1]
                reach = stop * max(length + longest - 2 * kth, 0.0)
                if bounds[at] > reach:
                    break
            rows = np.concatenate([np.arange(a, b) for a, b in tree.ranges[leaves[at : at + step]]])
            at += step
            step = min(step * 2, 256)
            away = projected[rows] - p
            away = np.einsum("ij,ij->i", away, away)
            if reach < np.inf:
                # the test holds for each point whose own projected distance is beyond reach
                rows = rows[away <= reach]
                if not len(rows):
                    continue
            scores = points[rows] @ q
            found.append((rows, scores))
            # every distinct vector counts with its copies
            best = np.concatenate([best, np.repeat(scores, np.minimum(copies[rows], k + 1))])
            if len(best) > k + 1:
                best = best[np.argpartition(best, len(best) - k - 1)[len(best) - k - 1 :]]
        rows, scores = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        n = min(len(rows), 2 * k + 2)
        top = np.argpartition(-scores, n - 1)[:n] if n < len(rows) else np.arange(len(rows))
        least = scores[top].min()
        top = np.flatnonzero(scores >= least)
        pairs = []
        for r in top:
            own = ids[by_copy[lo[rows[r]] : lo[rows[r]] + min(copies[rows[r]], k + 1)]]
            pairs += [(-scores[r], i) for i in own.tolist() if i != qid]
        pairs.sort()
        for s, i in pairs[: 2 * k]:
            out_q.append(position)
            out_id.append(i)
            out_score.append(-s)
    return np.array(out_q, np.int64), np.array(out_id, np.int64), np.array(out_score)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _search(k: int, options: dict):
    def run(key: tuple, base: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not base.num_rows or not asked.num_rows:
            return empty
        width, longest = key[0].as_py(), base.column("longest")[0].as_py()
        vectors, queries = _matrix(base.column("v"), width), _matrix(asked.column("q"), width)
        ids, query_ids = base.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        position, found, _ = search_block(ids, vectors, query_ids, queries, k, longest, **options)
        return pa.table({"query_id": query_ids[position], "vec_id": found, "score": _exact(ids, vectors, queries, position, found)})

    return run


def _exact(ids, vectors, queries, position, found) -> np.ndarray:
    order = np.argsort(ids, kind="stable")
    rows = order[np.searchsorted(ids[order], found)]
    return np.einsum("ij,ij->i", vectors[rows], queries[position])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with finite, nonzero vectors of double components, one of each vec_id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = 20, block: int = BLOCK, query_block: int = QUERIES, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every row that is_query holds for."""
    shelf = Shelf(vectors.sparkSession)
    rows = shelf.put(usable(vectors).withColumn("width", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    # one row per vector length: its blocks, its blocks of queries, and its longest vector
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.sum(is_query.cast("int")).alias("asked"))
    widths = shelf.put(widths.select("width", "longest", parts(F.col("n"), block).alias("blocks"), parts(F.col("asked"), query_block).alias("parts")))
    placed = rows.join(widths, "width")
    base = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("width", "block", "part", "vec_id", "v", "longest")
    queries = placed.where(is_query).select(F.col("width").alias("long"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "blocks", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("parts")).cast("int").alias("of"))
    queries = queries.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).select("long", "meets", "of", "query_id", "q")
    found = base.groupBy("width", "block", "part").cogroup(queries.groupBy("long", "meets", "of")).applyInArrow(_search(k, options), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_projected_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
