from collections import Counter

import pytest

from lucerna.operators import audit, ranking


@pytest.fixture
def rows(spark):
    return spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' ELSE 'small' END AS s")


def test_exact_sizes(spark, rows):
    parts = ranking.split(rows, "doc_id", "s", {"dev": 101, "hold": 53}, "rest")
    got = [(r.doc_id, r.s, r.split) for r in parts.collect()]
    assert len(got) == len({x[0] for x in got}) == 1000
    assert Counter(x[2] for x in got) == {"dev": 101, "hold": 53, "rest": 846}
    for name, size in (("dev", 101), ("hold", 53)):
        share = Counter(x[1] for x in got if x[2] == name)
        assert all(abs(share[s] - size * w) <= 1 for s, w in (("big", 0.7), ("mid", 0.2), ("small", 0.1)))
    assert got and sorted(got) == sorted((r.doc_id, r.s, r.split) for r in ranking.split(rows.repartition(7), "doc_id", "s", {"dev": 101, "hold": 53}, "rest").collect())
    ranking.require(ranking.checks(parts, "doc_id", {"dev": 101, "hold": 53, "rest": 846}))
    with pytest.raises(AssertionError, match="size_dev"):
        ranking.require(ranking.checks(parts, "doc_id", {"dev": 100, "hold": 53, "rest": 846}))
    with pytest.raises(AssertionError, match="disjoint_dev_hold"):
        twice = parts.union(parts.where("split = 'dev'").limit(1).selectExpr("doc_id", "s", "'hold' AS split"))
        ranking.require(ranking.checks(twice, "doc_id", {"dev": 101, "hold": 54, "rest": 846}))


def test_too_few(spark, rows):
    with pytest.raises(ValueError):
        ranking.split(rows.union(spark.createDataFrame([(5000, "lone")], "doc_id long, s string")), "doc_id", "s", {"dev": 10}, "rest")
    with pytest.raises(ValueError):
        ranking.split(rows, "doc_id", "s", {"dev": 1001}, "rest")
    with pytest.raises(AssertionError):
        ranking.require_rows(rows, 999)
    ranking.require_rows(rows, 1000)


def test_ranks_are_global_order(spark, rows):
    keyed = rows.withColumn("k", ranking.shuffled_key(1, "doc_id"))
    got = {}
    for r in ranking.ranked(keyed, ["s"], "k", "doc_id").collect():
        got.setdefault(r.s, []).append((r.rank, r.k))
    for x in got.values():
        assert [k for _, k in sorted(x)] == sorted(k for _, k in x) and [n for n, _ in sorted(x)] == list(range(1, len(x) + 1))


def test_seeded_sample(rows):
    a = [r.doc_id for r in ranking.seeded(rows, "doc_id", 20, 42).collect()]
    assert len(set(a)) == 20 and a == [r.doc_id for r in ranking.seeded(rows.repartition(9), "doc_id", 20, 42).collect()]
    assert a != [r.doc_id for r in ranking.seeded(rows, "doc_id", 20, 43).collect()]


def test_drift_and_rounding(spark, rows):
    part = rows.where("s <> 'small'")
    got = {r.s: (r.part_pct, r.ok) for r in audit.drift(rows, part, "s").collect()}
    assert got["small"] == (0.0, False) and got["big"][1] is False
    sizes = audit.recommended_sizes(spark.range(25)).first()
    assert (sizes.dev, sizes.holdout, sizes.main_test) == (2, 1, 22)  # 2.5 rounds to 2


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 5), (3, "b", 5), (4, "a", 6)], "i long, t string, n int")
    got = {r.column_name: (r.dtype, r.n_distinct, r.n_empty, r.examples) for r in audit.profile(df, ["t", "n"], "i").collect()}
    assert got == {"t": ("string", 3, 1, ["a", "b", "a"]), "n": ("int", 2, 1, ["5", "5", "6"])}
