"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beam.

Inserting a batch of nodes, a greedy search over the graph so far proposes neighbours; relaxed distance pruning
keeps the nearest and drops what a kept neighbour is closer to by a factor, so that edges stay diverse; edges
are put in both ways and pruned again where a node has too many. A query walks every shard's graph with a beam.
Largest inner products become smallest distances by one more component, the root of M^2-|x|^2 (M: largest norm).
Vectors of a shard whose norms are far apart have graphs of their own, each with its own M: beside one very long vector,
all distances of the others would cancel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.common import blocks, dealt, finite, matrix, one_per_id, widened

INDEX = "shard int, node int, ids array<long>, v array<double>, neighbours array<int>, start int"


def beam_search(x, square, edges, start: int, queries, width: int, keep_walk: bool = False):
    """The ``width`` nearest found of every query, as nodes (-1: none) and squared distances less |q|^2, nearest first.

    With ``keep_walk``, also the nodes walked through, which are the proposals for new edges.
    """
    n, b = len(x), len(queries)
    beam = np.full((b, width), -1, np.int32)
    far = np.full((b, width), np.inf, np.float32)
    left = np.zeros((b, width), bool)
    beam[:, 0], left[:, 0] = start, True
    far[:, 0] = square[start] - 2 * queries @ x[start]
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    walk, walk_far = [], []
    active = np.arange(b)
    while True:
        open_far = np.where(left[active], far[active], np.inf)
        at = open_far.argmin(1)
        go = np.isfinite(open_far[np.arange(len(active)), at])
        active, at = active[go], at[go]
        if not len(active):
            break
        node = beam[active, at]
        left[active, at] = False
        if keep_walk:
            step, step_far = np.full(b, -1, np.int32), np.full(b, np.inf, np.float32)
            step[active], step_far[active] = node, far[active, at]
            walk.append(step)
            walk_far.append(step_far)
        near = edges[node]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(near >= 0, near, node[:, None])] = True
        d = square[near] - 2 * np.einsum("aed,ad->ae", x[near], queries[active])
        d[~fresh] = np.inf
        all_ids, all_far = np.hstack([beam[active], near]), np.hstack([far[active], d])
        all_left = np.hstack([left[active], fresh])
        best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[active] = np.take_along_axis(all_far, best, 1)
        beam[active] = np.where(np.isfinite(far[active]), np.take_along_axis(all_ids, best, 1), -1)
        left[active] = np.take_along_axis(all_left, best, 1) & np.isfinite(far[active])
    order = np.argsort(far, axis=1, kind="stable")
    found = np.take_along_axis(beam, order, 1), np.take_along_axis(far, order, 1)
    if keep_walk:
        return (*found, np.array(walk).T.reshape(b, -1), np.array(walk_far).T.reshape(b, -1))
    return found


def robust_prune(x, square, nodes, near, degree: int, relax: float):
    """Of each node's proposals ``near`` (-1: none), up to ``degree`` that no kept one is closer to by the factor ``relax``."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == nodes[:, None]] = -1
    points = x[near]
    d = square[near] + square[nodes][:, None] - 2 * np.einsum("bmd,bd->bm", points, x[nodes])
    d = np.maximum(d, 0)
    rest = np.where(near >= 0, d, np.inf)
    kept = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for i in range(degree):
        at = rest.argmin(1)
        alive = np.isfinite(rest[rows, at])
        if not alive.any():
            break
        pick = near[rows, at]
        kept[alive, i] = pick[alive]
        apart = square[near] + square[pick][:, None] - 2 * np.einsum("bmd,bd->bm", points, x[pick])
        rest[(relax * relax * apart <= d) | (near == pick[:, None])] = np.inf
    return kept


def build_graph(x: np.ndarray, degree: int = 32, width: int = 64, relax: float = 1.2, batch: int = 256):
    """Edges (n rows of up to twice ``degree`` nodes, -1: none) and the node where searches start."""
    n = len(x)
    square = np.einsum("nd,nd->n", x, x)
    start = int((square - 2 * x @ x.mean(0)).argmin())
    room = 2 * degree
    edges = np.full((n, room), -1, np.int32)
    count = np.zeros(n, np.int64)
    order = np.random.default_rng(0).permutation(n).astype(np.int32)
    order = order[order != start]
    done = 0
    while done < len(order):
        new = order[done : done + min(batch, max(1, done))]
        done += len(new)
        near, _, walk, _ = beam_search(x, square, edges, start, x[new], width, keep_walk=True)
        kept = robust_prune(x, square, new, np.hstack([near, walk]), degree, relax)
        edges[new, :degree] = kept
        edges[new, degree:] = -1
        count[new] = (kept >= 0).sum(1)
        # The same edges backwards, in order of the node that gets them.
        source, to = np.repeat(new, degree), kept.ravel()
        source, to = source[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        source, to = source[by], to[by]
        nodes, first, more = np.unique(to, return_index=True, return_counts=True)
        place = count[to] + np.arange(len(to)) - np.repeat(first, more)
        full = count[nodes] + more > room
        fits = np.repeat(~full, more)
        edges[to[fits], place[fits]] = source[fits]
        count[nodes[~full]] += more[~full]
        for i in range(0, int(full.sum()), batch):
            some = np.flatnonzero(full)[i : i + batch]
            wide = np.full((len(some), int(more[some].max())), -1, np.int32)
            for r, k in enumerate(some):
                wide[r, : more[k]] = source[first[k] : first[k] + more[k]]
            kept = robust_prune(x, square, nodes[some], np.hstack([edges[nodes[some]], wide]), degree, relax)
            edges[nodes[some], :degree] = kept
            edges[nodes[some], degree:] = -1
            count[nodes[some]] = (kept >= 0).sum(1)
    return edges, start


def lifted(x: np.ndarray) -> np.ndarray:
    """One more component, so that the nearest to (q, 0) has the largest product with q."""
    square = np.einsum("nd,nd->n", x, x)
    return np.hstack([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]]).astype(np.float32)


def norm_classes(x: np.ndarray) -> np.ndarray:
    """The class of each row (not zero) by its norm, rounded to a power of 4; norms of one class differ by a factor of 4 at most."""
    most = np.abs(x).max(1)
    unit = x / most[:, None]
    return np.rint((np.log2(most) + 0.5 * np.log2(np.einsum("nd,nd->n", unit, unit))) / 2).astype(np.int64)


def build_graphs(x: np.ndarray, degree: int = 32, width: int = 64, relax: float = 1.2):
    """Edges of one graph per class of norms, and for each node the one where searches of its graph start."""
    n, of = len(x), norm_classes(x)
    edges, start = np.full((n, 2 * degree), -1, np.int32), np.zeros(n, np.int32)
    for c in np.unique(of):
        own = np.flatnonzero(of == c).astype(np.int32)
        near, first = build_graph(lifted(x[own] / np.abs(x[own]).max()), degree, width, relax)
        edges[own] = np.where(near >= 0, own[near], -1)
        start[own] = own[first]
    return edges, start


def search_graphs(x: np.ndarray, edges: np.ndarray, start: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray:
    """For each query the nodes found in the graphs, up to ``width`` of each (-1: none)."""
    unit = queries / np.abs(queries).max(1, keepdims=True)
    unit = np.hstack([unit, np.zeros((len(unit), 1))]).astype(np.float32)
    found = []
    for first in np.unique(start):
        own = np.flatnonzero(start == first).astype(np.int32)
        place = np.full(len(x), -1, np.int32)
        place[own] = np.arange(len(own))
        graph = lifted(x[own] / np.abs(x[own]).max())
        inner = np.where(edges[own] >= 0, place[edges[own]], -1)
        square = np.einsum("nd,nd->n", graph, graph)
        near = [beam_search(graph, square, inner, place[first], unit[i : i + 256], width)[0] for i in range(0, len(unit), 256)]
        near = np.concatenate(near)
        found.append(np.where(near >= 0, own[near], -1))
    return np.hstack(found)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (doubles) of rows with an id and a vector that is finite and not zero."""
    some = F.exists(vector_col, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)) & F.coalesce(some, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )


def build_index(vectors: DataFrame, n_shards: int, degree: int = 32, width: int = 64, relax: float = 1.2) -> DataFrame:
    """One row per different vector of a shard: the ids that have it, the vector, its edges, its graph's start node.

    Input: ``id``, ``v``. A shard is a hash of the id, so copies of a vector spread over all shards.
    """

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, x = one_per_id(t["id"].to_numpy(), matrix(t["v"]))
        by = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[by], x[by]
        new = np.ones(len(ids), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        first = np.flatnonzero(new)
        x = x[first]
        edges, start = build_graphs(x, degree, width, relax)
        n = len(x)
        at = np.append(first, len(ids)).astype(np.int32)
        kept = edges >= 0
        return pa.table({
            "shard": pa.array(np.full(n, key[0].as_py(), np.int32)),
            "node": pa.array(np.arange(n, dtype=np.int32)),
            "ids": pa.ListArray.from_arrays(at, ids),
            "v": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], x.ravel()),
            "neighbours": pa.ListArray.from_arrays(np.append(0, kept.sum(1).cumsum()).astype(np.int32), edges[kept]),
            "start": pa.array(start),
        })

    return vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(build, INDEX)


def search_shard(query_ids, queries, index: pa.Table, k: int, width: int):
    """Each query's best ``k`` of one shard: query ids, ids, products in double precision."""
    index = index.sort_by("node")
    x = matrix(index["v"])
    wide = max(x.shape[1], queries.shape[1])
    x, queries = widened(x, wide), widened(queries, wide)
    edges = matrix_of_nodes(index["neighbours"])
    owners, start = index["ids"].to_pylist(), index["start"].to_numpy()
    out = []
    near = search_graphs(x, edges, start, queries, width)
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        for j, own in enumerate(query_ids[i : i + 256]):
            nodes = near[i + j][near[i + j] >= 0]
            # Sums along each row: equal vectors get equal scores in every shard.
            score = (x[nodes] * q[j]).sum(1)
            listed = [(-s, d) for s, node in zip(score, nodes, strict=True) for d in [d for d in owners[node][: k + 1] if d != own][:k]]
            out += [(own, d, -s) for s, d in sorted(listed)[:k]]
    return tuple(np.array([o[i] for o in out], (np.int64, np.int64, np.float64)[i]) for i in range(3))


def matrix_of_nodes(column) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(lengths), max(1, int(lengths.max(initial=0)))), -1, np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 8192,
    query_rows: int = 8192,
    degree: int = 32,
    build_width: int = 64,
    width: int = 128,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest inner products found, ties to smaller ids.

    Every row is indexed, whatever its norm: a shard has a graph per class of norms, and all are searched. Copies of a vector share a node that lists their ids, so ties are whole. Shards and
    blocks of queries form a grid; each cell is one group of bounded size.

    Rows with a null id, or a vector that is null, zero, or has null or non-finite components take no part; shorter
    vectors count as filled with zeros; rows that share an id count once (the smallest vector); a query is never its
    own neighbour; empty tables give no rows. Other columns are ignored.
    """
    q, c = (valid_vectors(df, id_col, vector_col) for df in (queries, vectors))
    n_q, n_shards = blocks(q.count(), query_rows), blocks(c.count(), shard_rows)
    index = build_index(c, n_shards, degree, build_width)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            found = search_shard(*one_per_id(left["id"].to_numpy(), matrix(left["v"])), right, k, max(width, k + 1))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    cells = dealt(q, "id", "qb", n_q, "shard", n_shards).groupBy("qb", "shard").cogroup(
        index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).groupBy("qb", "shard")
    )
    best = cells.applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
