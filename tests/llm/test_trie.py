import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lucerna.llm import trie
from lucerna.llm.common import table

COLUMNS = "conv_id long, turn int, role string, text string, pos int, `left` string"


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest()), role, text))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if made[c] == k)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.prefix_trie(df).collect())


def test_all_conversations(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    got = found(df)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]) and len(got) > 30


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_turns(spark, monkeypatch, seed):
    """Few different turns, so that many conversations share long beginnings, are equal or begin others; one holds a third of all rows;
    blocks and pieces are small."""
    monkeypatch.setattr(trie, "BLOCK", 9)
    monkeypatch.setattr(trie, "PIECE", 20)
    rng = random.Random(seed)
    rows = []
    for c in range(0, 160):
        stem = rng.choice(["", "a", "ab", "abab", "bbbb", "aaaaaaaaaaaa"])
        for k, t in enumerate(stem + "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 9])))):
            rows.append((c, k, "user" if k % 2 else None, None if t == "b" else "é" + t, k, "x"))
    rows += [(500, k, "user", rng.choice("ab"), k, "x") for k in range(400)] + [(500, 3, "user", "a", 1, "x"), (500, None, "z", "a", 1, "x"), (None, 1, "user", "a", 1, "x"), (-7, 1, "user", "a", 1, "x")]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert found(df) == brute([r[:4] for r in rows])


def test_few_rows(spark):
    one = spark.createDataFrame([(1, 0, "user", "a", 0, "x")], COLUMNS)
    assert found(one) == brute([(1, 0, "user", "a")])
    assert found(one.limit(0)) == []
    five = [(5, 0, "u", "a"), (5, 1, "u", "b"), (6, 0, "u", "c"), (8, 0, "u", "")]
    assert found(spark.createDataFrame([(*r, 0, "x") for r in five], COLUMNS)) == brute(five)


def test_intervals():
    """Nearest smaller values against a plain search, ends outside of the block being open."""
    rng = random.Random(3)
    for _ in range(200):
        low = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            low[0] = -1
        first = rng.randint(0, 5)
        left = [next((first + p for p in range(j - 1, -1, -1) if low[p] < v), None) for j, v in enumerate(low)]
        right = [next((first + q for q in range(j + 1, len(low)) if low[q] < v), None) for j, v in enumerate(low)]
        want = defaultdict(int)
        for j, v in enumerate(low):
            want[left[j], right[j], v] += v >= 0
        lefts, nodes = trie.intervals(low, first)
        assert lefts == left and sorted(nodes, key=str) == sorted(((*k, m) for k, m in want.items() if m), key=str)


def test_least_within():
    values = np.random.default_rng(2).integers(0, 99, 37)
    pairs = [(a, b) for a in range(37) for b in range(a + 1, 38)]
    start, stop = (np.array(x) for x in zip(*pairs))
    assert trie.least_within(values, start, stop).tolist() == [values[a:b].min() for a, b in pairs]


def test_running_sums(spark):
    """Sums over keys that lie in several partitions, past 64 bits."""
    rng = random.Random(4)
    rows = [(k if rng.random() < 0.5 else 7, j, rng.randint(-(2**63), 2**63 - 1), 1) for j in range(300) for k in [rng.randint(0, 9)]]
    df = spark.createDataFrame(rows, "k long, o int, x long, one long")
    sums, count, want = defaultdict(int), defaultdict(int), set()
    for k, o, x, _ in sorted(rows):
        sums[k] += x
        count[k] += 1
        want.add((k, o, (sums[k] + 2**63) % 2**64 - 2**63, count[k]))
    assert {tuple(r) for r in trie.running(df, "k", ["o"], ["x", "one"]).collect()} == want
