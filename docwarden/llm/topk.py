"""Exact top-k search by inner product of integer vectors, with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... equal segments. From mean and deviation of each segment follows, at every
resolution, a lower bound of the distance between two vectors: |q-c|^2 >= sum over segments of
L(mq-mc)^2 + (dq-dc)^2. With both norms known this is an upper bound of their product. Coarse to fine, candidates
whose bound cannot reach the k-th product found so far are put aside; what survives is computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.common import blocks, dealt, finite, matrix, widened

LEVELS = (1, 2, 4, 8, 16, 32)
LONG = 2**63 - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``v``: floor(scale * x) of every component as a long, for rows with an id and a finite vector."""
    return df.where(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"),
    )


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: segment sums over the root of the length, then deviations; a product of two rows bounds x.y from above."""
    n, width = x.shape
    length = -(-width // segments)
    cut = widened(x, length * segments).reshape(n, segments, length)
    sums = cut.sum(2)
    spread = np.maximum(np.einsum("nsl,nsl->ns", cut, cut) - sums**2 / length, 0.0)
    return np.hstack([sums / np.sqrt(length), np.sqrt(spread)])


def _products(c: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Exact integer products; beyond a long they stop at its limits."""
    if small:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in c]
    return np.array([max(-LONG, min(LONG, e)) for e in exact], np.int64)


def block_top_k(query_ids, queries, ids, vectors, k: int, survivors: dict[int, int] | None = None):
    """For each query of a block its best ``k`` of a block of candidates: query ids, ids, products.

    ``survivors`` gets the number of candidates that each level leaves, over all queries; level 0 is all there are.
    """
    width = max(queries.shape[1], vectors.shape[1], 1)
    queries, vectors = widened(queries, width), widened(vectors, width)
    high = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, vectors)]
    small = high[0] * high[1] * width < 2.0**53
    fine = [(segment_statistics(queries.astype(float), s), segment_statistics(vectors.astype(float), s)) for s in LEVELS if s <= width]
    slack = 1e-6 + 1e-9 * high[0] * high[1] * width
    out = []
    for j, own in enumerate(query_ids):
        alive = np.flatnonzero(ids != own)
        bound = fine[0][1][alive] @ fine[0][0][j]
        least = -np.inf
        left = [len(alive)]
        for level, (of_query, of_all) in enumerate(fine):
            if level:
                bound = of_all[alive] @ of_query[j]
            if len(alive) <= k:
                break
            # The k most hopeful candidates, computed exactly, give a product that the others must reach.
            hopeful = alive[np.argpartition(-bound, k - 1)[:k]]
            least = max(least, float(_products(vectors[hopeful], queries[j], small).min()))
            alive = alive[bound >= least - slack]
            left.append(len(alive))
        if survivors is not None:
            for level, n in zip((0, *LEVELS), left):
                survivors[level] = survivors.get(level, 0) + n
        score = _products(vectors[alive], queries[j], small)
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), own), ids[alive][best], score[best]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def exact_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    query_rows: int = 4096,
    vector_rows: int = 16384,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query the ``k`` largest integer products, ties to smaller ids.

    Both sides are dealt into blocks by a hash of the id; each pair of blocks is one group of bounded size, whatever
    vectors repeat. Only ``k`` rows per query and block are shuffled on.

    Rows with a null id, a null vector, or a null or non-finite component take no part; shorter vectors count as filled
    with zeros. All rows that share an id are candidates; queries that share one share its ``k`` ranks, over the pairs of both. No row
    is a candidate of a query with its id. Products
    beyond a long stop at its limits. Empty tables give no rows. Other columns are ignored.
    """
    q, c = (quantised(df, id_col, vector_col, scale) for df in (queries, vectors))
    n_q, n_c = blocks(q.count(), query_rows), blocks(c.count(), vector_rows)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            sides = [(t["id"].to_numpy(), matrix(t["v"], np.int64)) for t in (left, right)]
            found = block_top_k(*sides[0], *sides[1], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    cells = dealt(q, "id", "qb", n_q, "cb", n_c).groupBy("qb", "cb").cogroup(
        dealt(c, "id", "cb", n_c, "qb", n_q).groupBy("qb", "cb")
    )
    best = cells.applyInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
