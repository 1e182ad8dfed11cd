import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def vectors(seed=0, n=400, d=24, copies=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)).astype(np.float32)
    x[n - copies :] = x[7]
    return [(i, v.tolist(), "clash") for i, v in enumerate(x)]


ODD = [
    (1001, None, "a"), (1002, [1.0, None], "a"), (1003, [float("nan"), 1.0], "a"), (1004, [float("inf")], "a"),
    (None, [1.0] * 24, "a"), (1005, [], "a"), (3, [9.0, 1.0], "a"), (3, [9.0, 1.0], "a"), (20, [-5.0, 2.0], "a"),
]


def test_top_k_equals_brute_force(spark):
    rows = vectors() + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    out = topk.exact_top_k(df.where("vec_id % 10 = 0"), df, k=5, query_rows=15, vector_rows=60).collect()
    # Rows that share an id are all there, as candidates and as queries.
    ints = []
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints.append((i, [int(np.floor(256 * float(x))) for x in v] + [0] * (24 - len(v))))
    want = {}
    for q in {i for i, _ in ints if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(mine, c)), i) for own, mine in ints if own == q for i, c in ints if i != q)[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == want


def test_bounds_hold_and_large_components_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (50, 30))
    for s in topk.LEVELS:
        f = topk.segment_statistics(x.astype(float), s)
        assert (f @ f.T >= x @ x.T - 1e-6).all()
    big = np.array([[2**40, 1], [2**40, 2], [2**39, 3]], np.int64)
    q, i, score = topk.block_top_k(np.array([0]), big[:1], np.array([0, 1, 2]), big, 2)
    assert list(i) == [1, 2] and list(score) == [2**63 - 1, 2**63 - 1]


def test_levels_put_candidates_aside():
    rng = np.random.default_rng(4)
    # Components that change slowly along the vector, as those of a rotated or smoothed embedding do.
    x = np.floor(256 * np.cumsum(rng.normal(0, 0.2, (3000, 64)), 1)).astype(np.int64)
    ids = np.arange(len(x))
    left: dict[int, int] = {}
    q, i, score = topk.block_top_k(ids[:20], x[:20], ids, x, 5, left)
    exact = x[:20] @ x.T
    exact[ids[:20], ids[:20]] = -(2**62)
    assert score.tolist() == [s for row in exact for s in sorted(row.tolist(), reverse=True)[:5]]
    shares = [left.get(level, 0) / left[0] for level in (0, *topk.LEVELS)]
    assert all(a >= b for a, b in zip(shares, shares[1:])) and shares[-1] < 0.02 and shares[3] < 0.5


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, none).count() == 0
    assert ann.nearest(none, none).count() == 0


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_neighbours_recall_ties_and_scores(spark, shard_rows):
    rows = vectors(2, 900, 16, 90) + ODD + [(2000, [0.0] * 16, "zero")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ann.nearest(df.where("vec_id % 20 = 0"), df, k=20, shard_rows=shard_rows, query_rows=20).collect()
    x = {}
    for i, v, _ in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[i] = np.array(v + [0.0] * (16 - len(v)), np.float64) if len(v) <= 16 else None
    x[3] = np.array([9.0, 1.0] + [0.0] * 14) if tuple([9.0, 1.0]) < tuple(rows[3][1]) else x[3]
    x[3] = min([np.array(rows[3][1], float), np.array([9.0, 1.0] + [0.0] * 14)], key=lambda v: v.tolist())
    hit = total = 0
    by = {}
    for r in out:
        assert r.score == pytest.approx(float((x[r.query_id] * x[r.vec_id]).sum()), abs=1e-9)
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert 2000 not in by and set(by) == {i for i in x if i % 20 == 0}
    for q, got in by.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        best = sorted((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q)[:20]
        hit += len({i for _, i in best} & {g[2] for g in got})
        total += 20
    assert hit / total >= 0.95


@pytest.mark.parametrize("low, high", [(1, 1), (0.51, 1.99), (1e3, 1e3), (1e3, 1e6), (1e-12, 1e12)])
def test_recall_beside_vectors_of_other_norms(low, high):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[1000:1100].copy()
    x[:5] *= np.geomspace(low, high, 5)[:, None]
    edges, start = ann.build_graphs(x)
    near = ann.search_graphs(x, edges, start, q, 128)
    score, hit = q @ x.T, 0
    for j, best in enumerate(np.argsort(-score, axis=1)[:, :20]):
        nodes = near[j][near[j] >= 0]
        hit += len(set(best) & set(nodes[np.argsort(-score[j, nodes])[:20]]))
    assert hit / 2000 >= 0.98


def test_pruned_edges_are_diverse():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1], [5, 5]], np.float32)
    square = (x**2).sum(1)
    kept = ann.robust_prune(x, square, np.array([0]), np.array([[1, 2, 3, 4, -1, 1]], np.int32), 4, 1.2)
    assert kept[0].tolist()[:2] in ([1, 3], [3, 1]) and 2 not in kept[0]


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    plan = topk.exact_top_k(df.where(F.col("vec_id") % 50 == 0), df)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
