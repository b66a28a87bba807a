import heapq
import pickle

import numpy as np

from lucerna.llm import mtree


def brute(rows, k=10):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = np.floor(1024 * np.array(x, float)).astype(int)
    out = set()
    for q in (i for i in v if i % 100 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:k]
        out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<float>, score double")
    v = mtree.quantised(df, "vec_id", "embedding")
    return {tuple(r) for r in mtree.top_k(v.where("vec_id % 100 = 0"), v, **options).collect()}


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, d)).astype(np.float32)
    x[rng.integers(0, n, copies)] = x[0]
    return [(i, list(map(float, r))) for i, r in enumerate(x)]


def test_brute_force(spark):
    rows = vectors(1500, 8, 0)
    assert found(spark, rows, tree_rows=256) == brute(rows)


def test_blocks_and_ties(spark):
    """Many equal vectors: ties go to smaller ids, also over several cells and trees."""
    rows = vectors(900, 4, 1, copies=500)
    assert found(spark, rows, tree_rows=128, cells=5) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.1, -0.2]), (500, [-1.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == set()
    assert found(spark, [(None, None)]) == set()
    assert found(spark, [(0, [1.0, 2.0]), (7, [1.0])]) == set()  # another length takes no part


def test_lengths(spark):
    """Vectors are compared within each length, over several trees and cells; empty ones take no part."""
    some, others = vectors(700, 4, 3), [(i + 1000, x) for i, x in vectors(300, 7, 4)]
    want = brute(some) | brute(others)
    odd = [(-2, []), (-1, [0.5]), (0, []), (0, [9.0]), (300, [])]
    assert len(want) == 100 and found(spark, [*odd, *others, *some], tree_rows=64, cells=7) == want
    assert found(spark, [(0, []), (1, [])]) == set()


def test_pruning_skips_distances():
    """On clustered vectors most distances aren't computed."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (40, 6))
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 3, (8000, 6))).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(1).max()) * (1 + 1e-12)
    tree, count = mtree.build(np.arange(8000), x, top), []
    for q in range(0, 200, 10):
        best = []
        mtree.search(tree, x[q], q, top, best, 10, count)
        score = x @ x[q]
        want = heapq.nsmallest(10, ((-int(s), i) for i, s in enumerate(score) if i != q))
        assert sorted((-s, -i) for s, i in best) == want
    assert np.mean(count) < 4000


def test_large_components(spark):
    """Scores that wouldn't fit raise instead of wrapping round."""
    import pytest

    with pytest.raises(ValueError):
        found(spark, [(0, [3e38, 1.0]), (1, [3e38, 2.0])])
    assert found(spark, [(0, [1e6, 1.0]), (1, [-1e6, 2.0])]) == brute([(0, [1e6, 1.0]), (1, [-1e6, 2.0])])


def test_queries_go_to_few_trees(spark):
    """On clustered vectors, of all query and tree pairs few are probed after the first."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 2, (24, 5))
    rows = [(i, [float(c) for c in centres[i % 24] + rng.normal(0, 0.01, 5)]) for i in range(6000)]
    df = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    trees, tops, roots = mtree.index(df, 512, 64)
    root, q = roots[5], np.array([r.v for r in df.where("vec_id % 100 = 0").orderBy("vec_id").collect()])
    x = np.array([r.v for r in df.collect()])
    floor = np.sort(q @ x.T, axis=1)[:, -11]
    assert len(root["id"]) > 8 and (mtree.bounds(q, root["centre"], root["radius"], tops[5]) >= floor[:, None]).mean() < 0.5
    assert sum(len(pickle.loads(r.tree)["ids"]) for r in trees.collect()) == 6000
    assert found(spark, rows[:3000], tree_rows=512, cells=64) == brute(rows[:3000])
