import random

import numpy as np
import pytest
import xxhash

from lucerna.llm import common, simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{row: smallest id reachable} by comparing all pairs."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(prints))]


def test_fingerprints(spark, hard):
    got = sorted((r.doc_id is None, r.doc_id, r.fp % 2**64) for r in simhash.fingerprints(hard).collect())
    assert got == sorted((r.doc_id is None, r.doc_id, brute_print(r.text)) for r in hard.collect())


def test_words_split_as_stated():
    for text in ("a b c", "A B", "\x1ca b", "İ K", "one two three four five"):
        assert simhash.fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 65, 500])
def test_index_finds_all(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
    v = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    v = np.unique(v)
    q, at = simhash.GrayIndex(v).within(v, 4)
    assert sorted(zip(q.tolist(), at.tolist())) == [(i, j) for i in range(len(v)) for j in range(len(v)) if int(v[i] ^ v[j]).bit_count() <= 4]


def test_gray_rank():
    x = np.arange(64, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


@pytest.mark.parametrize("chunk,blocks,levels", [(512, 5, 3), (8, 5, 2), (512, 7, 3), (8, 6, 0), (30, 5, 1)])
def test_components(spark, chunk, blocks, levels, monkeypatch):
    """Chains of near prints, copies, prints that share a block with many, null ids; also with groups cut into tiny chunks, and
    with more blocks, as for many fingerprints."""
    rng = random.Random(chunk)
    prints = [(i, rng.getrandbits(64)) for i in range(60)]
    x = rng.getrandbits(64)
    for i in range(60, 160):  # a chain: each some bits from the last
        x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
        prints.append((i, x))
    prints += [(i, x ^ (rng.getrandbits(40) << 20)) for i in range(160, 260)]  # share the low block
    prints += [(260, 0), (261, 15), (262, 31), (None, 0), (263, 0), (0, prints[0][1]), (None, rng.getrandbits(64))]
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in prints]
    original = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, distance: original(d, distance, chunk, blocks, levels))
    got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, s, c) for (i, s), c in zip(signed, brute_components(prints))), key=key)


def test_blocks_grow_with_the_count():
    assert [simhash.blocks_for(n, 4, 512) for n in (0, 300_000, 10_000_000, 10**11)] == [5, 5, 6, 8]
    for blocks in (5, 6, 7, 8):
        chosen = [m % 2**64 for m in simhash.masks(4, blocks)]
        assert len(chosen) == len(set(chosen))
        rng = random.Random(blocks)
        for _ in range(300):  # any four bits leave a mask untouched
            bits = sum({1 << b for b in rng.sample(range(64), 4)})
            assert any(not m & bits for m in chosen)


def test_star_components(spark):
    """A hub, long chains and lone pairs."""
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {tuple(r) for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(1, 300)} | {(k, 1000) for k in range(1001, 1201)} | {(5000, 4000)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark, empty):
    assert simhash.components(simhash.fingerprints(empty)).count() == 0


def test_longer_keys_miss_no_link():
    """Two values that agree on a mask and differ in up to four bits agree on one of the longer masks."""
    rng = random.Random(4)
    for first in simhash.masks(4, 5):
        for mask in simhash.longer(first, 4):
            more = simhash.longer(mask, 4)
            assert all(m & mask == mask for m in more)
            rest = [k for k in range(64) if not mask >> k & 1]
            for _ in range(50):
                bits = sum(1 << b for b in rng.sample(rest, 4))
                assert any(not m & bits for m in more)


def test_hot_groups_stay_linear(spark):
    """Members of a large group go to longer keys, not to pairs of chunks: rows grow with the members."""
    rng = random.Random(6)
    rows = [(rng.getrandbits(51) << 13) % 2**63 for _ in range(20_000)]  # share a block
    df = spark.createDataFrame([(x,) for x in set(rows)], "fp long")
    dealt = simhash.grouped(df, simhash.masks(4, 5), lambda m: simhash.longer(m, 4), 256, 3)
    assert dealt.count() < 12 * len(set(rows)) and dealt.groupBy("block", "key", "i", "j").count().where("count > 256").count() == 0


def test_nearest_forest():
    rng = np.random.default_rng(3)
    left, right, weight = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    got = simhash.nearest_forest(40, left, right, weight)
    order, root, total = np.argsort(weight, kind="stable"), list(range(40)), 0

    def find(x):
        return x if root[x] == x else find(root[x])

    for k in order:
        if find(left[k]) != find(right[k]):
            root[find(left[k])] = find(right[k])
            total += weight[k]
    assert weight[got].sum() == total and len(got) == 39


def near_copies(seed, n=150):
    """Texts with exact copies, near ones of several degrees, and others that share a passage with them."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randint(0, 3000)}" for _ in range(k)]
    passage, out = say(60), []
    for _ in range(n):
        base = say(rng.choice([3, 8, 30, 120, 400]))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = say(1)[0]
            out.append(rng.choice([" ", "\n"]).join(copy))
        if rng.random() < 0.3:
            out.append(" ".join(say(50) + passage + say(50)))
    return [*out, "", None, " ", "One two", "one two"]


def borderline(seed, n=60):
    """Chains of copies whose neighbours are just about similar enough, within texts made mostly of a common passage."""
    rng = random.Random(seed)
    say = lambda k: [f"v{rng.randint(0, 900)}" for _ in range(k)]
    passage, out = say(80), []
    for _ in range(n):
        text = passage + say(rng.choice([10, 20, 25]))
        for _ in range(rng.randint(1, 5)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = say(1)[0]
    return out


def test_distinct_texts(spark):
    """Against the similarity of all pairs: every link is found, and of each group one stays."""
    texts = near_copies(1) + borderline(2)
    df = spark.createDataFrame([(k % 700, t, {"k": k}, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp map<string,int>, of_id string")
    kept = {r.fp["k"] for r in simhash.distinct_texts(df).collect()}
    data, root = [(t or "").encode() for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, pairs = [simhash.shingles(t) for t in data], 0
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] & sets[b] or not (sets[a] or sets[b]):
                if simhash.similar(data[a], data[b]) >= 0.8:
                    pairs += 1
                    root[find(a)] = find(b)
    groups = {find(k) for k in range(len(texts))}
    assert {find(k) for k in kept} == groups  # no group is lost: clean texts stay
    assert pairs > 200 and len(kept) == len(groups)


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_distinct_texts_in_chunks(spark, monkeypatch, frequent):
    """As above where groups of a token are dealt out in small chunks, whichever shingles count as frequent."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash._across, "__defaults__", (8,))
    monkeypatch.setattr(simhash.frequent_shingles, "__defaults__", (frequent, 40))
    texts = borderline(4, 25)
    sets = [simhash.shingles(t.encode()) for t in texts]
    left, right = zip(*[(a, b) for a in range(len(texts)) for b in range(a) if simhash.similar(texts[a].encode(), texts[b].encode()) >= 0.8])
    root = simhash.forest(np.arange(len(texts)), np.array(left), np.array(right))
    got = {r.doc_id for r in simhash.distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == set(root.tolist()) and len(sets) > len(got) > 10


def test_prefixes_of_similar_sets_meet():
    """Whatever is frequent, sets of the similarity share a hash of their prefixes; parities bound how many hashes differ."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)]))
        often = np.unique(rng.choice(x, len(x) // 2)) if len(x) > 1 else x[:0]
        level = rng.integers(6, 9, len(often))
        same = len(np.intersect1d(x, y))
        if same >= 0.8 * (len(x) + len(y) - same):
            assert len(np.intersect1d(*(np.concatenate(simhash.prefix(z, often, level)) for z in (x, y))))
        assert np.bitwise_count((simhash.parities(x) ^ simhash.parities(y)).view(np.uint64)).sum() <= len(x) + len(y) - 2 * same


def test_repeated_lines_link_nothing(spark):
    """Texts that share a line repeated through them, and little else, all stay; near copies of one of them go."""
    rng = random.Random(9)
    say = lambda k: [f"w{rng.randint(0, 3000)}" for _ in range(k)]
    texts = [" ".join(["na"] * 200 + say(100)) for _ in range(40)] + [("accept all cookies now\n" * 80) + " ".join(say(60)) for _ in range(40)]
    near = [texts[0] + " more", texts[40] + " more"]
    got = {r.doc_id for r in simhash.distinct_texts(spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")).collect()}
    assert got == set(range(80))
    same = [simhash.set_fingerprint(simhash.shingle_set(t)) for t in (b"a b c d e", b"A b  c d e", b" ")]
    assert same[0] == same[1] and same[2] == 0


def test_distinct_rows(spark, hard, empty):
    """Rows that share an id and differ in their texts both stay; equal rows are one; a row without an id goes before others."""
    rows = [(1, "some words here and there", "a"), (1, "quite different words are in this row", "b"), (2, "some words here and there", "c"), (None, None, None), (None, "x", None), (3, "", "d"), (5, "again", "e"), (5, "again", "f"), (None, "y", "g"), (None, "y", "h")]
    got = [tuple(r) for r in simhash.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")).collect()]
    assert sorted(map(str, {r[:2] for r in got})) == sorted(map(str, {(1, "some words here and there"), (1, "quite different words are in this row"), (None, "x"), (3, ""), (5, "again"), (None, "y")})) and len(got) == 6
    assert simhash.distinct_texts(empty).count() == 0 and simhash.distinct_texts(hard).columns == hard.columns


def test_wide_parities_fold_and_tell_long_sets_apart():
    rng = np.random.default_rng(4)
    for n in (0, 1, 512, 513, 5000):
        found = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        wide = simhash.wide_parities(found)
        assert len(wide) * 64 >= max(512, len(found))
        while len(wide) > 8:
            wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
        assert (wide == simhash.parities(found)).all()
    a, b = (np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) for _ in range(2))
    apart = lambda f: int(np.bitwise_count((f(a) ^ f(b)).view(np.uint64)).sum())
    assert apart(simhash.parities) <= 10000 / 9 < apart(simhash.wide_parities)


def test_tokens_of_one_set_count_once(spark):
    """Of twenty tokens with the same classes one is left, of those with other classes each; tokens of one root none."""
    rows = [(t, c, c) for t in range(20) for c in (1, 2, 3)] + [(50, c, c) for c in (1, 2)] + [(60, c, 7) for c in (8, 9)]
    got = simhash._telling(spark.createDataFrame(rows, "token long, c long, root long"))
    assert sorted(map(tuple, got.collect())) == [(0, 1), (50, 1)]
