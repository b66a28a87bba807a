import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from lucerna.operators import audit, runs


@pytest.mark.parametrize("most", [3, 900, 10**6, 2**40])
def test_medians(spark, most):
    """Exact over small and very large numbers, for odd and even groups, groups of one, a null group and one of nulls."""
    rng = random.Random(most)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([0, 1, rng.randint(0, most), None])) for _ in range(700)] + [("one", 5), ("two", 1), ("two", most), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    of = {}
    for g, v in rows:
        if v is not None:
            of.setdefault(g, []).append(v)
    assert {r.g: r["median"] for r in audit.medians(df, "v", ["g"]).collect()} == {g: float(median(v)) for g, v in of.items()}
    assert audit.medians(df, "v", []).first()["median"] == float(median([v for _, v in rows if v is not None]))


def test_buckets_are_few_and_in_order(spark):
    cut, head = audit._bucket(F.col("id"))
    rows = spark.range(0, 1 << 20, 7).select("id", cut.alias("c"), head.alias("h"))
    got = rows.orderBy("c", "h", "id").select("id").collect()
    assert [r.id for r in got[:5000]] == list(range(0, 35000, 7)) and rows.select("c", "h").distinct().count() < (20 - audit.BITS + 2) << audit.BITS


def test_length_stats(spark):
    df = spark.createDataFrame([("a", "xx"), ("a", "xxxxx"), ("b", None), (None, "x"), (None, ""), ("a", "")], "g string, t string")
    got = {r.g: (r.n, r.min_len, r.max_len, r.median_len) for r in audit.length_stats(df, "t", "g").collect()}
    assert got == {"a": (3, 0, 5, 2.0), "b": (0, None, None, None), None: (2, 0, 1, 0.5)}
    assert audit.length_stats(df, "t").first().median_len == 1.0 and audit.length_stats(df.limit(0), "t").first().n == 0
    assert audit.per_group_stats(df, "g").first().median_n == 2.0


def test_matrix_of_a_table(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "name string, x int")
    got = [tuple(r) for r in runs.matrix(spark, df, ["da", "sc"]).orderBy("cell_no").collect()]
    assert got == [(1, "a", "da"), (2, "a", "sc"), (3, "b", "da"), (4, "b", "sc")]
    assert [tuple(r) for r in runs.matrix(spark, ["y", "x"], ["da"]).orderBy("cell_no").collect()] == [(1, "y", "da"), (2, "x", "da")]
