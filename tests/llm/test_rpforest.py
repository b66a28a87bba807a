import numpy as np
import pytest

from lucerna.llm import rpforest
from lucerna.llm.common import table


def brute(rows, cosine=0.93):
    """rows: (id, vector, label); (n_links, component as the smallest place) for each."""
    ok = [v is not None and len(v) > 0 and x is not None and all(y is not None and np.isfinite(y) for y in v) and any(y != 0 for y in v) for _, v, x in rows]
    unit = [np.array(v, float) / np.abs(v).max() if good else None for (_, v, _), good in zip(rows, ok)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return links, [find(k) for k in range(len(rows))]


def clustered(seed, n, dim=24, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))
    x[: n // 3] = centres[0] + spread * rng.standard_normal((n // 3, dim))  # a hot group
    return x


def test_against_all_pairs(spark):
    """Small leaves and samples, so that trees are deep, fitted in several rounds, and tight leaves are dealt out in chunks."""
    x = clustered(1, 900)
    rows = [(k, v.tolist(), int(k % 5 == 0)) for k, v in enumerate(x)]
    rows += [(900 + k, rows[3 * k][1], rows[3 * k][2]) for k in range(100)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in rpforest.near_vectors(df, leaf=40, sample=300).collect()}
    links, roots = brute(rows)
    assert len(got) == len(rows) and all(got[k].n_links <= links[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links) > 0
    assert sum(got[k].component_id != roots[k] for k in got) <= 0.01 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_on_vectors_apart_by_the_threshold(spark):
    """Pairs at cosines from 0.93 to 0.96 in many dimensions, among unrelated vectors."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((1500, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.standard_normal(base.shape)
    off -= (off * base).sum(1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.96, len(base))[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * off])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = rpforest.near_vectors(df, leaf=100).where("n_links > 0").count()
    assert 0.98 * len(x) <= got <= len(x)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (2, v, 1), (None, v, 1), (7, v, None), (8, None, 1), (9, [], 1), (10, [0.0, 0.0, 0.0], 1), (11, [1.0, None, 3.0], 1), (12, [1.0, float("nan"), 3.0], 1), (13, [float("inf"), 2.0, 3.0], 1), (14, [1.0, 2.0], 1), (15, [-1.0, -2.0, -3.0], 1), (16, [1e-30, 2e-30, 3e-30], 1), (17, v, 2), (2, v, 1), (None, [5.0, 0.0, 0.0], 3), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, node string, k1 int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.near_vectors(df).collect()), key=str)
    alone = [(k, 0, k, True) for k in (7, 8, 9, 10, 11, 12, 13, 14, 15, 17)]
    want = [(5, 4, 2, False), (2, 4, 2, True), (2, 4, 2, True), (None, 4, 2, False), (16, 4, 2, False), (None, 0, None, False), (None, 0, None, False)] + alone
    assert got == sorted(want, key=str)
    assert rpforest.near_vectors(df.limit(0)).count() == 0


def test_pairs_count_once():
    """A pair counts in the first leaf that both are in."""
    lists = np.array([[3, 7, -1], [3, 9, -1], [7, 9, -1], [-1, -1, -1]])
    met = lambda a, b, leaf: rpforest.first_met(lists[[a]], lists[[b]], leaf)[0]
    assert met(0, 1, 3) and met(0, 2, 7) and met(1, 2, 9) and met(3, 3, -1)
    assert not rpforest.first_met(np.array([[3, 7]]), np.array([[3, 7]]), 7)[0]


def test_all_vectors(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    links, roots = brute(rows)
    got = {r.vec_id: r for r in rpforest.near_vectors(df).collect()}
    assert [(got[x].n_links, got[x].component_id) for x, _, _ in rows] == [(n, rows[k][0]) for n, k in zip(links, roots)]
