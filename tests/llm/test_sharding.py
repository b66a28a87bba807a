from collections import Counter

import pytest
import xxhash

from lucerna.llm import sharding

SHARDS = [f"s{k}" for k in range(11)]


def brute(shards, slots):
    """Each shard's whole permutation, then turns."""
    order = {s: [(xxhash.xxh64_intdigest(s, 1) + j * (xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards}
    assert all(sorted(x) == list(range(slots)) for x in order.values())
    owner = {}
    while len(owner) < slots:
        for s in shards:
            if len(owner) < slots:
                owner[next(x for x in order[s] if x not in owner)] = s
    return [owner[k] for k in range(slots)]


def test_table():
    got = [SHARDS[k] for k in sharding.lookup_table(SHARDS, 211)]
    assert got == brute(SHARDS, 211)
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    a = [SHARDS[k] for k in sharding.lookup_table(SHARDS)]
    b = [SHARDS[:-1][k] for k in sharding.lookup_table(SHARDS[:-1])]
    moved = sum(x != y for x, y in zip(a, b)) / len(a)
    assert moved < 2.5 / len(SHARDS)


def test_placement(spark, hard, empty):
    table = sharding.lookup_table(SHARDS, 211)
    got = sharding.place(hard, "doc_id", SHARDS, 211).collect()
    assert len(got) == hard.count()
    for r in got:
        want = xxhash.xxh64_intdigest(str(r.doc_id), 42) if r.doc_id is not None else 42
        want -= 2**64 * (want >= 2**63)
        assert r.slot == want % 211 and r.shard == SHARDS[table[r.slot]]
    assert sharding.place(empty, "doc_id", SHARDS).count() == 0


def test_wrong_input(spark):
    for bad in ([], ["a", "a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 2)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 12)
    with pytest.raises(ValueError):
        sharding.place(spark.range(3).withColumnRenamed("id", "slot"), "slot", SHARDS)


def test_write(spark, tmp_path):
    placed = sharding.place(spark.range(500).withColumnRenamed("id", "doc_id"), "doc_id", SHARDS, 211)
    sharding.write(placed, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}
